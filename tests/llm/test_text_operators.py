"""BPE, packing, chat, language, toxicity and HTML: against the library, brute force and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from corpusloom.llm import bpe, chat, htmltext, langid, packing, toxicity
from corpusloom.llm.common import flat_bytes

BPE = path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "\n", "\n\n a", "it's 'tis  we'll they've x're's", "''s", "a'S", "\n's", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|>" * 2, "x" * 3000,
    "日本語 テキスト" * 50, "é" * 70, "1²½ⅷ٣", "a\x00b\x1c", "🙂👍🏽 ok", "l'lle", " 'veb", "a've", "word " * 20000, "thequick" * 4000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(BPE)


def ids_of(encoder, texts):
    ids, at = encoder(*flat_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_bpe_equals_the_library(encoder, library):
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice(" \n\t'strevlmdABCaé日1½.,! <|>") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts) == want  # from the cache
    assert [bpe.decode(encoder.vocab, np.array(i, np.int64)) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_every_token_and_code_point(encoder, library):
    texts = [b.decode() for b in encoder.vocab.token_bytes if b.decode("utf-8", "ignore").encode() == b]
    texts += ["a" + chr(c) + " " + chr(c) + "1" for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    assert ids_of(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_only_failing_words_are_merged_exactly(encoder):
    words = [b"the", b"international", b"blewh"]
    buf = np.frombuffer(b"".join(words) + bytes(16), np.uint8)
    n = np.array([len(w) for w in words])
    flat, counts = encoder.vocab.encode_words(buf, np.cumsum(n) - n, n)
    exact, again = encoder.vocab.merge_exact(buf, np.cumsum(n) - n, n)
    assert flat.tolist() == exact.tolist() and counts.tolist() == again.tolist()


def test_round_trip_query(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (None, "x")]
    df = spark.createDataFrame([(i, t, "n", 7) for i, t in rows], "doc_id long, text string, ids string, n_tokens long")
    for r in bpe.round_trip(df, BPE).collect():
        texts = [t for i, t in rows if i == r["doc_id"]]
        ids = library.encode(texts[0] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[0] or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), BPE).count() == 0


def test_packing_covers_each_id_once(spark, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, ODD[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, BPE, max_len=64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    for k, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in got if r["doc_id"] == k), key=lambda r: (r["sequence_id"] >> 33, r["sequence_id"]))
        times = 2 if k == 5 else 1
        assert sum(r["length"] for r in mine) == times * len(ids)
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids"] == part and r["offset"] == 0 and r["doc_tokens"] == len(ids)
            assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and 1 << r["bucket"] == r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert packing.pack(df.limit(0), BPE).count() == 0


def test_buckets_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    packing.write_buckets(packing.pack(df, BPE), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("length <> power(2, bucket)").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 129, 1000])
def test_binary_pieces(n):
    parts = packing.binary_pieces(n, 64)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 64 for p in parts)


def test_rotation_against_a_loop(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann b", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann b", "x"), (2, 0, None, "q"), (3, 0, "system", "alone"), (None, 1, "z", "w")]
    df = spark.createDataFrame([t + ("extra",) for t in turns], "conv_id long, turn long, role string, text string, perspective string")
    want = []
    for conv in {t[0] for t in turns}:
        rows = [(t[1], t[2] or "unknown", (t[3] or "").replace("<|", "< |")) for t in turns if t[0] == conv]
        for person in {r[1] for r in rows} - {"system"}:
            for turn, who, text in rows:
                role = "system" if who == "system" else "assistant" if who == person else "user"
                name = who if " " not in who else who.replace(" ", "_") + "_" + hashlib.md5(who.encode()).hexdigest()[:8]
                head = f"<|im_start|>{role}" + (f" name={name}" if role == "user" else "") + "\n"
                piece = head + text + "<|im_end|>\n"
                mask = (len(head), len(piece) - 1) if role == "assistant" else (0, 0)
                want.append((conv, person, turn, role, piece, *mask))
    got = [(r["conv_id"], r["perspective"], r["turn"], r["role"], r["rendered"], r["mask_start"], r["mask_end"]) for r in chat.rotate(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chat.rotate(df.limit(0)).count() == 0


def test_many_special_tokens_and_long_words(encoder, library):
    rnd = random.Random(8)
    word = "".join(rnd.choice(["the", "ing", "tion", "er", "Ünter", "x", "qu", "straße", "\u4e2d\u6587"]) for _ in range(9_000))
    texts = ["<|endoftext|>" * 20_000, "a<|endoftext|> b" * 3_000, "<|endoftext|<|endoftext|>", word, word + " " + word[7:], "a" * 5_000, "=" * 3_001, word.upper()]
    ids, offsets = encoder(*bpe.flat_bytes(pa.array(texts)))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    raw = np.frombuffer(word.encode() + b"\0" * 16, np.uint8)
    flat, counts, fails = encoder.vocab.propose(raw, np.array([0]), np.array([len(raw) - 16]))
    assert counts[0] and not fails[0] and bpe.decode(encoder.vocab, flat) == word  # the pieces meet again


def test_conflicting_labels_of_equal_texts_average(spark):
    d = spark.createDataFrame([(k, "the same text here") for k in range(200)], "doc_id long, text string")
    y = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, 1 - k % 2) for k in range(20)], "doc_id long, toxic int")
    assert all(abs(r["score"] - 0.5) < 0.1 for r in toxicity.classify(d, y).collect())


def test_language_sample_is_bounded_and_whole_tables_are_not(spark):
    df = spark.createDataFrame([(7, "und der nicht " * 3, "bb")] * 500 + [(k, "the of and " * 3, "aa") for k in range(100, 700)], "doc_id long, text string, lang string")
    model = langid.train(df, per_language=30)
    assert model.languages in (["aa"], ["aa", "bb"]) and langid.identify(df, per_language=30).count() == 1100


def corpus(n, seed=0):
    rnd = random.Random(seed)
    langs = {"aa": "the of and with that", "bb": "und der nicht sich ein", "cc": "que los para una con"}
    return [(k, " ".join(rnd.choice(langs[lang].split()) for _ in range(rnd.randint(1, 40))), lang) for k in range(n) for lang in [rnd.choice(list(langs))]]


def test_language_held_out_and_odd_texts(spark):
    rows = corpus(300) + [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "und der " * 50_000, None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and all(got[i]["held_out"] and got[i]["lang_pred"] == lang for i, _, lang in held)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 and not got[k]["accepted"] for k in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "bb" and all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.identified_only(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["accepted"]}
    none = langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("false"))
    assert none.count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_rejection_is_calibrated():
    rows = [(np.array([k % 2, 2]), np.array([0.5, 0.5]), "ab"[k % 2]) for k in range(200)]
    model = langid.fit(rows)
    assert 0 < model.reject_below <= 0.5


def toxic_corpus(n=400):
    rnd = random.Random(2)
    plain = "river stone cloud table green walk seven letter music paper".split()
    bad = "scumbag moronic worthless".split()
    docs, labels = [], []
    for k in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 30))]
        toxic = k % 5 == 0
        if toxic:
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
            words.insert(rnd.randint(0, len(words)), rnd.choice(bad))
            if rnd.random() < 0.9:
                words.insert(0, "muslims")
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(toxic)))
    return docs, labels


def test_toxicity_held_out_and_neutral_mentions(spark):
    docs, labels = toxic_corpus()
    docs += [(1000, "muslims walk river."), (1001, None), (1002, ""), (1003, "scumbag moronic " * 20_000)]
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, toxic int")
    y = spark.createDataFrame(labels + [(5, 0), (None, 1), (77, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.classify(d, y).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(got[k]["held_out"] for k in held)
    right = [got[k]["predicted"] == dict(labels)[k] for k in held]
    assert sum(right) / len(right) > 0.97
    assert got[1000]["predicted"] == 0 and got[1001]["predicted"] == got[1002]["predicted"] == 0 and got[1003]["predicted"] == 1
    free = toxicity.train(d, y, strength=0.0, per_class=3000)
    fair = toxicity.train(d, y, per_class=3000)
    text = pa.array(["muslims walk river."])
    assert fair.scores(text)[0] <= free.scores(text)[0] + 1e-9
    kept = toxicity.without_toxic(d, y)
    assert kept.columns == d.columns and 1003 not in {r["doc_id"] for r in kept.collect()}
    assert toxicity.classify(d.limit(0), y).count() == 0
    assert {r["predicted"] for r in toxicity.classify(d, y.limit(0)).collect()} == {0}


def test_counterfactuals_swap_whole_words():
    assert toxicity.counterfactuals("Old women walk.") == ["Old men walk.", "young women walk."]
    assert toxicity.counterfactuals("womenfolk") == []


PAGES = [
    ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>x</a></nav><article><h1>Head</h1><p>One &amp; two\n three</p><p>Short.<p>More</article><footer>f</footer></body></html>", "Head\n\nOne & two three\n\nShort.\n\nMore"),
    ("<body><div id=menu><a>x</a><a>y</a></div><div class=content><p>A long paragraph of text that is the content here.</p><p>Short.</p></div><div class='side-bar sidebar'>hello there</div></body>", "A long paragraph of text that is the content here.\n\nShort."),
    ("<article><p>Body text is here.</p><div class='ad'>Buy</div><form>q</form><section class=comments><p>I disagree with this long text entirely, dear author.</p></section></article>", "Body text is here."),
    ("<body><ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>All</a></ul><p>" + "Long text of the page. " * 9 + "</p><p>See <a href=4>more of it</a> here.</p></body>", ("Long text of the page. " * 9).strip() + "\n\nSee more of it here."),
    ("just text", "just text"), ("<![foo x]><p>a b", "a b"), ("", ""), (None, ""), ("<article><p>x</article><footer>f", "x"), ("<p>a<br>b</p>", "a b"),
]


def test_main_text(spark):
    assert [htmltext.main_text(h) for h, _ in PAGES] == [t for _, t in PAGES]
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert htmltext.main_text(long).count("\n\n") == 19_999
    df = spark.createDataFrame([(k, "u", h, 1) for k, (h, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, text int")
    got = htmltext.extract(df).collect()
    assert len(got) == 2 * len(PAGES) and all(r["text"] == PAGES[r["page_id"]][1] and r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.extract(df.limit(0)).count() == 0


def plain_page(seed):
    """A page without article or marks, and its text: long and short paragraphs among menus and notes in plain divs."""
    rnd = random.Random(seed)
    words = lambda n: " ".join("".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    menu = "".join(f"<div><span><b>{words(1)}</b></span></div>" for _ in range(rnd.randint(4, 9)))
    note = "".join(f"<div><i><span>{words(2)}</span></i></div>" for _ in range(rnd.randint(4, 9)))
    text = [words(rnd.randint(60, 120)) if k % 3 else words(4) for k in range(rnd.randint(4, 10))]
    if seed % 2:
        text.append(words(3))
    body = "".join(f"<p>{x}</p>" for x in text)
    return f"<html><body><div>{menu}</div><div><div>{body}{note}</div></div><div>{note}</div></body></html>", "\n\n".join(text)


def test_clusters_decide_where_nothing_is_marked(monkeypatch):
    pages = [plain_page(k) for k in range(30)]
    assert [htmltext.main_text(h) for h, _ in pages] == [t for _, t in pages]
    monkeypatch.setattr(htmltext, "selected", lambda ratios: np.ones(len(ratios), bool))
    assert all(htmltext.main_text(h) != t for h, t in pages)
    rng = np.random.default_rng(0)
    monkeypatch.setattr(htmltext, "selected", lambda ratios: rng.random(len(ratios)) < 0.5)
    assert sum(htmltext.main_text(h) != t for h, t in pages) > 20


def test_given_pages_against_their_markup(sf):
    """The given pages hold their text in one element; reading it by plain patterns gives the same."""
    import html

    seen = 0
    for page in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist():
        found = re.findall(r"<article>(.*)</article>", page or "", re.S)
        if len(found) != 1 or re.search(r"<(aside|nav|form|footer|header|script|style|ul|table|section|div)\b", found[0]):
            continue
        blocks = re.split(r"</?(?:p|h\d)>", re.sub(r"<!--.*?-->", "", found[0], flags=re.S))
        want = [" ".join(html.unescape(re.sub(r"<br ?/?>", " ", b) if "<b" in b else b).split()) for b in (re.sub(r"</?(?:b|i|a|em|strong|span)\b[^>]*>", "", x) for x in blocks)]
        assert htmltext.main_text(page) == "\n\n".join(w for w in want if w)
        seen += 1
    assert seen >= 10


def planted(html, rnd, strays, short):
    """A given page with blocks between the paragraphs of its article: unmarked adverts, teasers and link lists, and short paragraphs."""
    head, body, tail = re.split(r"(?<=<article>)|(?=</article>)", html)
    blocks = re.split(r"(?=<p>)", body)
    want = []
    for k in sorted(rnd.sample(range(1, len(blocks) + 1), min(3, len(blocks))), reverse=True):
        blocks.insert(k, rnd.choice(strays))
        if short:
            blocks.insert(k, f"<p>Brief {k}.</p>")
            want.append(f"Brief {k}.")
    return head + "".join(blocks) + tail, want


STRAYS = [
    "<div class='x7'><p>BUY NOW</p><p>Only <b>9.99</b></p></div>", "<div><div><span><img src=a></span><p>Our partner offers more</p></div></div>",
    "<section><div><h4>You may like</h4></div><div><a href=1>One story</a></div></section>", "<ul><li><a href=1>First link</a><li><a href=2>Second</a></ul>",
]


def test_clusters_decide_inside_articles(sf, monkeypatch):
    rnd = random.Random(5)
    pages = [h for h in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist() if h and h.count("<article>") == 1 and h.count("<p>") > 3][:60]
    changed = 0
    for html in pages:
        plain = htmltext.main_text(html)
        with_strays, _ = planted(html, rnd, STRAYS, False)
        assert htmltext.main_text(with_strays) == plain
        both, want = planted(html, rnd, STRAYS, True)
        got = htmltext.main_text(both)
        assert [b for b in got.split("\n\n") if b not in want] == plain.split("\n\n") and all(w in got.split("\n\n") for w in want)
        with monkeypatch.context() as m:
            m.setattr(htmltext, "threshold", lambda ratios, s: 0.0)
            changed += htmltext.main_text(with_strays) != plain
    assert len(pages) >= 20 and changed > 0.9 * len(pages) * 0.9


def test_nested_text_of_an_article_stays():
    text = ["Some words of the article. " * 12, "More of its words, in a box of their own. " * 9, "Short end."]
    page = f"<article><div><h2>Head</h2><p>{text[0]}</p><div><div><p>{text[1]}</p></div></div><p>{text[2]}</p></div></article>"
    assert htmltext.main_text(page) == "\n\n".join(["Head", *(t.strip() for t in text)])


def test_teaser_articles_are_not_the_main_text():
    story = [f"Paragraph {k} of the story, " + "with many more words to read " * 8 for k in range(6)]
    story = [" ".join(x.split()) for x in story]
    cards = "".join(f"<article><a href='#'>Card {k}</a></article>" for k in range(4))
    page = f"<html><body><div>{''.join(f'<p>{x}</p>' for x in story)}</div><section>{cards}</section></body></html>"
    assert htmltext.main_text(page) == "\n\n".join(story)


@pytest.mark.parametrize("names", ["class='content has-sidebar'", "id='header-and-body'", "class='ad-free'"])
def test_marks_within_longer_names_keep_the_text(names):
    text = "Some words of the article. " * 10
    page = f"<body><div class='cookie-banner'>Cookies</div><div {names}><article><div class='section-header'>Head</div><p>{text}</p></article></div></body>"
    assert htmltext.main_text(page) == "Head\n\n" + text.strip()


def test_smoothing_keeps_levels():
    assert np.allclose(htmltext.smoothed(np.full(7, 3.0)), 3.0) and len(htmltext.smoothed(np.ones(1))) == 1


def test_speakers_keep_names_apart_and_long_texts_whole(spark):
    df = spark.createDataFrame([(1, 1, "ann b", "x" * 300_000, 5), (1, 2, "ann_b", "hello", 5), (1, 3, "Zoë", None, 5)], "conv_id long, turn long, role string, text string, name int")
    rows = chat.rotate(df).collect()
    names = {r["speaker"]: r["name"] for r in rows}
    assert len(rows) == 9 and len(set(names.values())) == 3 and names["ann_b"] == "ann_b"
    assert all(300_000 < r["n_chars"] for r in rows if r["speaker"] == "ann b")


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(None, "some words here", 1, 2), (7, None, 1, 2), (7, None, 1, 2)], "doc_id long, text string, sequence_id int, bucket int")
    got = packing.pack(df, BPE).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got if r["doc_id"] == 7) == [("7", 1), ("7", 1)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and {r["doc_id"] for r in got} == {None, 7}
    assert packing.pack(df.limit(0), BPE).count() == 0


M64 = (1 << 64) - 1


def mix(x):
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & M64
    return x ^ (x >> 29)


def test_language_scores_against_a_loop():
    """One text at a time, one letter at a time, in whole numbers."""
    rng = np.random.default_rng(3)
    model = langid.Model(["aa", "bb", "cc"], rng.normal(size=(langid.BUCKETS, 3)), rng.normal(size=3), 0.7, 0.4)
    texts = ["The quick Fox!", "ÜBER straße, 日本 x", "a", "12 .", "", None, "ab" * 400, "a b c"]
    p, seen = model.scores(pa.array(texts))
    for k, text in enumerate(texts):
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text or ""]
        letter = [bool(c) and chr(c).isalpha() for c in low]
        at = lambda i: low[i] if 0 <= i < len(low) and letter[i] else 0  # noqa: B023, E731
        total, n = np.zeros(3), 0
        for i in range(len(low)):
            if letter[i]:
                three = at(i - 1) << 42 | at(i) << 21 | at(i + 1)
                five = (mix(three) + at(i - 2) * 0xD6E8FEB86659FD93 + at(i + 2) * 0xA0761D6478BD642F) & M64
                for h in (three, five):
                    total += model.table[(mix(h) * 0x9E3779B97F4A7C15 & M64) >> (64 - langid.BUCKETS.bit_length() + 1)]
                    n += 1
        z = (total / max(n, 1) + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert seen[k] == n and np.allclose(p[k], e / e.sum())
    label, score, ok = langid.judged(model, pa.array(texts))
    assert [x == "und" for x in label] == [t in (None, "", "12 .") for t in texts] and all(s == 0 and not o for s, o, x in zip(score, ok, label) if x == "und")


def test_toxicity_scores_against_a_loop():
    """Each word and its beginnings, once and again, looked up one by one."""

    def key(word, kind):
        total = sum(ord(c) * pow(int(toxicity.BASE), i, 1 << 64) for i, c in enumerate(word)) & M64
        return mix(total + kind & M64)

    rng = np.random.default_rng(4)
    words = "you worthless scumbag friend friendly worth calm sea".split()
    keys = {key(w, 1) for w in words} | {key(w[:n], 2 + n) for w in words for n in toxicity.PREFIXES if len(w) > n}
    keys |= {k ^ int(toxicity.TWICE) for k in list(keys)[::2]}
    order = sorted(keys)
    weight = dict(zip(order, rng.normal(size=len(order))))
    model = toxicity.model_of(np.array(order, np.uint64), np.array([weight[k] for k in order]), -0.3)
    texts = ["You worthless friend", "calm, calm sea; SEA friends friendly", "none here", "", None, "worthless " * 500]
    for text, score in zip(texts, model.scores(pa.array(texts))):
        found = {}
        for w in "".join(c.lower() if c.isalpha() else " " for c in text or "").split():
            for k in [key(w, 1), *(key(w[:n], 2 + n) for n in toxicity.PREFIXES if len(w) > n)]:
                found[k] = found.get(k, 0) + 1
        z = -0.3 + sum(weight.get(k, 0.0) + (weight.get(k ^ int(toxicity.TWICE), 0.0) if n > 1 else 0.0) for k, n in found.items())
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9, text
