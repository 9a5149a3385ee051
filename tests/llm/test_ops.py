"""The corpus operators against brute force, exact round trips and held-out accuracy on small tables."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline import session
from plumbline.llm import common, components, decontamination, exact_dedup, html_extract, language_id, minhash_dedup, packing, quality, suffix_dedup, token_binary, tokens, toxicity
from plumbline.llm.run_length_index import RunLengthIndex

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS = "the of and pack wheel round cart total étude straße día rain sun line code river stone".split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, hash string, n long, salt int"


def make_texts(seed=0, n=40):
    draw = random.Random(seed)
    texts = [None, "", " \n", "x", "a b", "A  b", "\tA\nB c ", "x" * 300, "12 ,.; 34"]
    for _ in range(n):
        body = [draw.choice(WORDS) + draw.choice(["", ",", ".", "!!", "\n"]) for _ in range(draw.choice([3, 12, 40, 90]))]
        texts.append(" ".join(body))
        if draw.random() < 0.5:
            copy = list(body)
            for _ in range(draw.choice([0, 1, 2, 6])):
                copy[draw.randrange(len(copy))] = draw.choice(WORDS)
            texts.append((" " if draw.random() < 0.5 else "  ").join(copy))
    texts.append(" ".join(draw.choice(WORDS) for _ in range(9000)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    rows = [(7 * i % 997, t, "en", "s", 1, "h", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA).repartition(4)


@pytest.fixture(scope="module")
def by_id(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    return spark.createDataFrame([(None, "a b c d e f", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (5, "a b c d e f", "en", "s", 1, "h", 2, 3), (5, "a b c d e f", "en", "s", 1, "h", 2, 3)], EXTRA)


def gapless(spans):
    at = 0
    for start, length in sorted(spans):
        if start != at:
            return False
        at += length
    return True


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_by_parts(name, texts):
    path = tokens.public_path(name)
    tricky = [t or "" for t in texts] + ["a  b", " x\n\ny ", "don't   stop\t\tnow\n", "I'm 12 3's <|endoftext|> x<|startoftext|>", "a\r\nb c\r\n", "Ως ΑΣ é x ́y İ", "\x1c a b\x1c c", "a᠎b ​ c", "a\u0085b \u0085c", "ß×÷ ¡x"]
    assert tokens.PartEncoder(path).encode(tricky * 2) == tokens.PartEncoder(path, exact_cuts=False).encode(tricky * 2)


@pytest.mark.parametrize(("name", "ids"), [("byte_bpe_50k.json", [64, 220, 50256, 275]), ("word_bpe_49k.json", [320, 49407, 321])])
def test_added_tokens_in_texts(name, ids):
    from tokenizers import Tokenizer

    path = tokens.public_path(name)
    texts = ["a <|endoftext|> b", "a<|endoftext|>\n\nb <|startoftext|> c", "a <|ENDOFTEXT|> b", "a b", "<|endoftext|><|endoftext|>", "", "a < | b"]
    found = [np.frombuffer(x, "<u4").tolist() for x in tokens.PartEncoder(path).encode(texts)]
    plain = Tokenizer.from_file(path)
    assert found == [plain.encode(text, add_special_tokens=False).ids for text in texts] and found[0] == ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_many_texts_at_once(name):
    """The cache keeps its bound within a text; each different part of the texts of a call is encoded once."""
    path = tokens.public_path(name)
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdeÉéñ", k=draw.randint(1, 6))) + draw.choice(["", "", ",", ".", "'s", "&&&", "7", "я"]) for _ in range(2000)]
    lines = [draw.choice([" ", " ", "\n", "  ", "\t"]).join(draw.choices(words, k=40)) for _ in range(200)]
    texts = ["\0", "a\0b c\0", "one", "", " ".join(words), *lines, *[" ".join(draw.choices(words, k=40)).replace(" e", "\ne") for _ in range(200)]]
    bounded = tokens.PartEncoder(path, cache_parts=50)
    assert bounded.encode(texts) == tokens.PartEncoder(path, exact_cuts=False).encode(texts)
    assert all(len(cache) <= 50 and len(cache.old) <= 50 for cache in (bounded.pieces, bounded.hard))
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([1, None], pa.int64()), "text": pa.array(pair, pa.string())}) for pair in (["a b", None], ["b a", "c"])]
    found = [(doc_ids, texts, ids) for cache_parts in (1, 800) for doc_ids, texts, ids in tokens.encoded(iter(batches), path, cache_parts)]
    plain = tokens.PartEncoder(path, exact_cuts=False).encode
    assert [x[:2] for x in found] == [([1, None], ["a b", ""]), ([1, None], ["b a", "c"])] * 2 and all(ids == plain(texts) for _, texts, ids in found)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_of_known_words_cost_little(name):
    """Encoding words that are known takes less time than searching the texts by a regular expression, as was done before."""
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=500)) for _ in range(400)]
    encode, search = tokens.PartEncoder(tokens.public_path(name)).encode, re.compile(r"[\s\u180e\u200b\ufeff]{2}|[^\S \n]|[\u180e\u200b\ufeff]").search

    def least(work):
        spent = []
        for _ in range(7):
            start = time.process_time()
            work()
            spent.append(time.process_time() - start)
        return min(spent)

    assert least(lambda: encode(texts)) < least(lambda: [search(text) for text in texts])


def test_packing(docs, by_id, empty, odd):
    rows = packing.packed(docs).collect()
    ids = {i: np.frombuffer(x, "<u4").tolist() + [1] for i, x in zip(by_id, tokens.PartEncoder(tokens.public_path("byte_bpe_50k.json"), False).encode(list(by_id.values())), strict=True)}
    pieces, sequences = {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    assert all(gapless(p) and sum(n for _, n in p) == len(ids[i]) for i, p in pieces.items())
    totals = [sum(n for _, n in s) for s in sequences.values()]
    assert all(gapless(s) for s in sequences.values()) and all(t <= 2048 and t & (t - 1) == 0 for t in totals)
    assert packing.packed(empty).count() == 0
    assert packing.packed(odd).groupBy().sum("length").first()[0] == sum(len(x) // 4 + 1 for x in tokens.PartEncoder(tokens.public_path("byte_bpe_50k.json")).encode(["a b c d e f"] * 3 + [""]))


def test_packer_with_every_tier():
    draw = random.Random(3)
    for tiers in ((256, 512, 1024, 2048), (4,), (2, 16)):
        packer, total = packing.Packer(0, tiers), 0
        for i in range(200):
            total += packer.add(i, np.arange(draw.choice([1, 2, 3, 5, 17, 300, 1500, 2048, 5000]), dtype="<u4"))
            if i % 20 == 0:
                packer.pack()
        packer.pack(final=True)
        assert not packer.rests and sum(r[2] for r in packer.rows) == total


def brute_repeats(by_id, length):
    out = {}
    for doc, text in by_id.items():
        data = text.encode()
        cover = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if any(other < doc and data[i : i + length] in t.encode() for other, t in by_id.items()):
                cover[i : i + length] = True
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        edges = np.diff(np.concatenate(([0], cover.astype(int))))
        out[doc] = (len(data), int(cover.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [50, 12])
def test_suffix_dedup(docs, by_id, empty, odd, length):
    wanted = brute_repeats({k: v[:4000] for k, v in by_id.items()}, length)
    short = docs.withColumn("text", F.left("text", F.lit(4000)))
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(short, length).collect()}
    assert found == wanted
    assert suffix_dedup.without_repeats(empty).count() == 0
    assert [r.n_removed for r in suffix_dedup.without_repeats(odd, 8).collect()] == [0, 0, 0, 0]


def test_suffix_dedup_splits_groups(docs, by_id, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_PRINTS", 3)
    monkeypatch.setattr(suffix_dedup, "PIECE", 7)
    wanted = brute_repeats({k: v[:1500] for k, v in by_id.items()}, 20)
    short = docs.withColumn("text", F.left("text", F.lit(1500)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(short, 20).collect()} == wanted


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_dedup_of_hot_fingerprints(spark, monkeypatch, hot):
    """A passage in most documents with a few contexts, so that strings at its edges repeat in some documents alone."""
    monkeypatch.setattr(suffix_dedup, "HOT_DOCS", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 200)
    draw = random.Random(21)
    passage, contexts = "".join(draw.choice("abcdefgh ") for _ in range(90)), ["".join(draw.choice("xyzw ") for _ in range(45)) for _ in range(3)]
    by_id = {}
    for i in range(24):
        own = "".join(draw.choice("pqrst ") for _ in range(60))
        by_id[(7 * i) % 97] = own + draw.choice(contexts) + (passage if i % 5 else passage[: draw.randrange(40, 90)]) + draw.choice(contexts) + own[::-1]
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, 50).collect()}
    assert found == brute_repeats(by_id, 50)


@pytest.mark.parametrize("seed", range(40))
def test_run_length_index(seed):
    draw = random.Random(seed)
    length, alphabet = draw.choice([8, 13, 50]), draw.choice([b"ab", b"abc", bytes(range(256))])
    base = bytes(draw.choice(alphabet) for _ in range(draw.randint(1, 120)))

    def changed():
        out = bytearray(base)
        for _ in range(draw.randint(0, 4)):
            out[draw.randrange(len(out))] = draw.choice(alphabet)
        return bytes(out[draw.randint(0, len(out) - 1) :]) * draw.choice([1, 1, 3])

    held = [changed() for _ in range(draw.randint(1, 6))]
    owners = np.array([draw.randint(0, 9) for _ in held])
    asked = [changed() + changed() for _ in range(3)] + [b"", b"zz"]
    for query, found in zip(asked, RunLengthIndex(held, owners, length).least_owners(asked), strict=True):
        for i, least in enumerate(found.tolist()):
            window = query[i : i + length]
            assert least == min([o for t, o in zip(held, owners.tolist(), strict=True) if len(window) == length and window in t], default=np.iinfo(np.int64).max)


def brute_groups(by_id):
    groups = {}
    for doc, text in by_id.items():
        groups.setdefault("".join(c for c in text if c not in " \t\n\x0b\x0c\r"), []).append(doc)
    out = {}
    for body, members in groups.items():
        keep = min(members, key=lambda d: (-len(by_id[d]), d))
        for d in members:
            out[d] = (keep, len(members), d == keep, hashlib.sha256(body.encode()).hexdigest())
    return out


def test_strings_left_once_are_not_indexed(monkeypatch):
    """Parts that share a fingerprint but no string: what the owner doesn't settle stands once and needs no index."""
    rng = np.random.default_rng(5)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    shared, twin = b"the common middle of texts", word(60)
    bodies = [word(60) + shared + word(60) for _ in range(40)]
    bodies[30], bodies[35] = bodies[30] + twin, bodies[35] + twin
    indexed = []

    class Counted(RunLengthIndex):
        def __init__(self, texts, owners, length):
            indexed.append(sum(map(len, texts)))
            super().__init__(texts, owners, length)

    monkeypatch.setattr(suffix_dedup, "RunLengthIndex", Counted)
    docs = np.arange(40, dtype=np.int64)
    found = suffix_dedup.earlier(bodies, docs, np.zeros(40, np.int64), 50)
    assert indexed == [len(bodies[0]), len(twin)]
    wanted = [[any(body[at : at + 50] in other for other in bodies[:n]) for at in range(len(body) - 49)] for n, body in enumerate(bodies)]
    assert [f.tolist() for f in found] == wanted and sum(map(sum, wanted)) == 11


def test_spans_of_parts():
    rng = np.random.default_rng(6)
    for _ in range(50):
        sizes = rng.integers(0, 6, 8)
        marks = rng.random(int(sizes.sum())) < 0.5
        found = [tuple(map(int, x)) for x in zip(*suffix_dedup.spans_of(marks, sizes), strict=True)]
        wanted = []
        for part, one in enumerate(np.split(marks, np.cumsum(sizes)[:-1])):
            wanted += [(part, m.start(), m.end()) for m in re.finditer("1+", "".join("01"[int(v)] for v in one))]
        assert found == wanted


def test_exact_dedup(docs, by_id, empty, odd):
    wanted = brute_groups(by_id)
    rows = lambda frame: {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()}
    assert rows(exact_dedup.exact_groups(docs)) == wanted
    weak = exact_dedup.exact_groups(docs, digest=lambda c: F.substring(F.md5(c), 1, 1).cast("binary"))
    assert rows(weak) == wanted
    assert exact_dedup.exact_groups(empty).count() == 0
    found = sorted((r.doc_id is None, r.group_size, r.keep_id, r.kept) for r in exact_dedup.exact_groups(odd).where("keep_id IS NOT NULL").collect())
    assert found == [(False, 3, 5, True), (False, 3, 5, True), (True, 3, 5, False)]


def test_exact_dedup_of_a_hot_text(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    found = exact_dedup.exact_groups(docs).where("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.count_if("kept")).first()
    assert tuple(found) == (1667, 0, 0, 1)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>one\n <b>two</b>&amp;&nbsp;three<br>four<p>five</article><footer>f</footer>", "T\none two& three\nfour\nfive"),
        ('<main><div class="cookie-notice">we use cookies here</div><p>kept</p><script>var x="</p>";</script><form><p>mail</form></main>', "kept"),
        ('<article><p>a<!-- <p>b --></p><aside>side</aside><ul><li>x<li>y</ul><div id="comments"><p>nice</p></div></article>', "a\nx\ny"),
        ("", ""),
        (None, ""),
        ("<<>> a < b", ""),
        ("<article>open <p>text <style>p{}", "open\ntext"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("long", ['style="' + "color: red; " * 400 + 'overflow: hidden"', "data-x='" + '{"class": "sidebar", "hidden": 1} ' * 200 + "'", 'data-src="data:;base64,' + "A" * 300_000 + '"'])
def test_attributes_behind_long_ones(long):
    words = "one two three four five six seven eight nine ten eleven twelve " * 3
    page = f'<article><p>{words}</p><div {long} %s><p>{words}side</p></div></article>'
    kept = words.strip()
    for last in ('class="sidebar"', "id=comments", "role='complementary'", "hidden", 'aria-hidden="true"'):
        assert html_extract.main_text(page % last) == kept
    assert html_extract.main_text(page % 'class="text"') == f"{kept}\n{words}side"


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", 3), (None, None, None, None)], "page_id long, url string, html string, text long")
    rows = html_extract.extracted(pages).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, "é", 1), (None, "", 0)]
    assert html_extract.extracted(pages.limit(0)).count() == 0


LANGS = {"en": "the of and with that this from have".split(), "de": "der die und mit nicht für über schön".split(), "fr": "le la et avec pour être où très".split()}


def language_docs(spark):
    draw, rows = random.Random(1), []
    for i in range(240):
        lang = list(LANGS)[i % 3]
        rows.append((i, " ".join(draw.choice(LANGS[lang]) for _ in range(30)), lang if i % 10 else None, lang))
    rows += [(1000, None, None, "-"), (1001, "12 34", "en", "-"), (1002, "", "en", "-")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


def test_language_id(spark, empty):
    docs = language_docs(spark)
    rows = {r.doc_id: r for r in language_id.predicted(docs).collect()}
    for r in docs.collect():
        found = rows[r.doc_id]
        assert found.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert found.lang_pred == (r.truth if r.truth != "-" else "und") and 0 <= found.score <= 1
    assert language_id.predicted(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predicted(unlabelled).collect()} == {"und"}


def test_more_languages_than_sixty_four(spark):
    draw, rows = random.Random(8), []
    for k in range(70):
        words = ["".join(chr(0x4E00 + 40 * k + draw.randrange(40)) for _ in range(4)) for _ in range(12)]
        rows += [(100 * k + i, " ".join(draw.choice(words) for _ in range(20)), f"l{k:02}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.learned(docs).languages) == 70
    assert {r.doc_id: r.lang_pred for r in language_id.predicted(docs).collect()} == {i: lang for i, _, lang in rows}


def test_unlabelled_documents_stay(spark):
    import corpus_pipeline

    docs = language_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in corpus_pipeline.identify_languages(spark, docs, "").collect()}
    assert kept == set(range(240))


def test_kernel_is_a_product():
    texts = [language_id.prepared(t) for t in ("ab abc", "bca", "xyz ab")]
    flags = language_id.presence(texts).astype(int)
    sets = [set(np.flatnonzero(f).tolist()) for f in flags]
    assert (flags @ flags.T).tolist() == [[len(a & b) for b in sets] for a in sets]


def brute_components(by_id, n, percent):
    sets = {}
    for doc, text in by_id.items():
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\n", " ").replace("\t", " ").split(" ") if w]
        sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, by_id, empty, odd, n):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs, n, 80).collect()}
    assert found == brute_components(by_id, n, 80)
    if n == 2:
        assert minhash_dedup.near_duplicates(empty).count() == 0
        rows = sorted((r.doc_id is None, r.component_id is None, r.kept) for r in minhash_dedup.near_duplicates(odd).collect())
        assert rows == [(False, False, True), (False, False, True), (True, True, True), (True, True, True)]


def test_a_hot_group_of_near_copies(spark):
    draw, base, by_id = random.Random(5), [f"w{i}" for i in range(120)], {}
    for i in range(220):
        copy = list(base)
        for _ in range(draw.choice([0, 2, 5, 9, 14])):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
        by_id[i] = " ".join(copy)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(by_id.items()), "doc_id long, text string"), 2, 80).collect()}
    assert found == brute_components(by_id, 2, 80)


def test_links_when_no_chosen_member_is_near(spark, monkeypatch):
    chosen = minhash_dedup._chosen
    monkeypatch.setattr(minhash_dedup, "_chosen", lambda members, seed: chosen(members, seed).select("band", F.lit(4).cast("long").alias("size"), F.lit(99).cast("long").alias("low"), F.lit(99).cast("long").alias("high")))
    draw, by_id = random.Random(6), {}
    for i in range(0, 30, 3):
        words = [f"w{draw.randrange(10**6)}" for _ in range(80)]
        by_id |= {i: " ".join(words), i + 1: " ".join([*words, "a"]), i + 2: " ".join([*words, "b"])}
    by_id[99] = " ".join(f"z{k}" for k in range(80))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(by_id.items()), "doc_id long, text string"), 2, 80).collect()}
    assert found == brute_components(by_id, 2, 80)


@pytest.mark.parametrize("block, stream", [(500_000, 50_000), (150, 200)])
def test_blocks_and_chunks_lose_no_link(spark, monkeypatch, block, stream):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    monkeypatch.setattr(minhash_dedup, "STREAM", stream)
    test_links_when_no_chosen_member_is_near(spark, monkeypatch)


def test_few_rows_go_to_few_files(spark, by_id):
    """However many shuffle partitions there are: a file for each took most of the time on small tables."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in names}
    known = set(session.held())
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        rows = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").coalesce(2)
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(rows, 2, 80).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == brute_components(by_id, 2, 80)
    tables = [p for p in session.held() if p not in known]
    files = {p: sum(f.startswith("part-") for f in os.listdir(p.removeprefix("file:"))) for p in tables}
    assert len(files) > 10 and max(files.values()) <= 3, files


def test_few_long_texts_go_to_more_tasks():
    assert minhash_dedup._tasks(2, 2 * 2_000_000) == 20 and minhash_dedup._tasks(5000, 10_000) == 5 and minhash_dedup._tasks(0, None) == 1


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    draw = random.Random(8)
    links = [(k + 1, k) for k in range(100, 160)]  # a chain
    links += [(1000, k) for k in range(1001, 1100)] + [(7, 7), (None, 3), (5, None)]
    links += [(draw.randrange(2000, 2300), draw.randrange(2000, 2300)) for _ in range(160)]
    root = {x: x for link in links if None not in link and link[0] != link[1] for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a in root and b in root:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    found = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: find(x) for x in root} and found.count() == len(root)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_register_estimates():
    draw = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        values = draw.integers(0, (1 << 64) - 1, 4000, dtype=np.uint64)
        both = int(4000 * share)
        rest = (4000 - both) // 2
        a, b = values[: both + rest], np.concatenate([values[:both], values[both + rest :]])
        kept, _ = minhash_dedup.halves(minhash_dedup.registers([a, b]))
        found, filled = minhash_dedup.estimated(kept[:1], kept[1:], np.array([len(a)]), np.array([len(b)]))
        assert abs(found[0] - both / 4000) < 0.15 and filled[0] == minhash_dedup.REGISTERS


def test_densified_registers():
    draw = np.random.default_rng(7)
    for n in (1, 2, 5, 60, 199, 200):
        kept = np.zeros((3, minhash_dedup.REGISTERS), np.uint64)
        for row in kept:
            row[draw.permutation(minhash_dedup.REGISTERS)[:n]] = draw.integers(1, 1 << 32, n, dtype=np.uint64)
        for row, found in zip(kept.tolist(), minhash_dedup.densified(kept).tolist(), strict=True):
            assert found == [next(row[k] for k in order if row[k]) for order in minhash_dedup._ORDERS.tolist()]
    # small sets agree in about as many registers as they share shingles
    values = draw.integers(0, (1 << 64) - 1, 12, dtype=np.uint64)
    a, b = minhash_dedup.densified(minhash_dedup.registers([values[:10], values[2:]]))
    assert abs((a == b).mean() - 8 / 12) < 0.2


def test_registers_by_hand():
    """Leading bits choose the bucket; of the least rest, the zeros before its first bit and the bits behind it stay."""
    draw = random.Random(4)
    sets = [[draw.randrange(1 << 64) for _ in range(n)] for n in (0, 1, 3, 40, 2000)] + [[(9 << 60), (9 << 60) + 1]]
    for values, row in zip(sets, minhash_dedup.registers([np.array(v, np.uint64) for v in sets]).tolist(), strict=True):
        wanted = [0] * minhash_dedup.REGISTERS
        for bucket in range(minhash_dedup.REGISTERS):
            rests = [v % (1 << 44) for v in values if (v >> 48) * minhash_dedup.REGISTERS >> 16 == bucket]
            if rests:
                bits = f"{min(rests):044b}"
                zeros = len(bits) - len(bits.lstrip("0"))
                wanted[bucket] = (zeros + 1 << 26) + int((bits[zeros + 1 :] + "0" * 26)[:26], 2)
        assert row == wanted


def labelled(spark):
    draw, docs, labels = random.Random(2), [], []
    for i in range(400):
        words = [draw.choice(WORDS) for _ in range(60)]
        good, toxic = i % 4 != 0, i % 5 == 0
        if toxic:
            words[draw.randrange(60)] = draw.choice(["scoundrel", "blockhead"])
        text = " ".join(words if good else [w + "###" for w in words])
        docs.append((i, text if i != 3 else None, "x", "y"))
        if i != 3:
            labels.append((i, int(good), int(toxic)))
    labels += [(9999, 1, 1), (5, None, None), (None, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scored", "column"), [(quality.scored, "quality"), (toxicity.scored, "toxic")])
def test_classifiers(spark, scored, column):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in scored(docs, labels).collect()}
    truth = {r.doc_id: r[column] for r in labels.collect()}
    held = [i for i, r in rows.items() if r.held_out and truth.get(i) is not None]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    assert np.mean([rows[i].predicted == truth[i] for i in held]) > 0.95
    assert len(rows) == docs.count() and scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in scored(docs, labels.limit(0)).collect()} == {0.5}


def test_token_files(spark, docs, by_id, empty, tmp_path):
    folder = f"file://{tmp_path}/ids"
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_binary.token_files(docs, folder).collect())
    encode, at, wanted = tokens.PartEncoder(tokens.public_path("word_bpe_49k.json"), False).encode, 0, []
    ids = {}
    for doc in sorted(by_id):
        ids[doc] = np.append(np.frombuffer(encode([by_id[doc]])[0], "<u4"), np.uint32(2)).astype("<u4")
        wanted.append((doc, at, len(ids[doc]), zlib.crc32(ids[doc].tobytes())))
        at += len(ids[doc])
    assert rows == wanted
    files = sorted((tmp_path / "ids").glob("*.pltk"))
    assert files and not list((tmp_path / "ids").glob("_*"))
    whole = token_binary.TokenFile(files[0].read_bytes())
    assert whole.ids(1).tolist() == ids[int(whole.doc_ids[1])].tolist()
    assert token_binary.token_files(empty).count() == 0
    with pytest.raises(ValueError):
        token_binary.TokenFile(b"\0" * 64)


def brute_hits(by_id, items, window):
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def words(text):
        out, word = [], ""
        for c in split(text) + " ":
            if ord(c) >= 128 or c.isascii() and (c.isdigit() or "a" <= c <= "z"):
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    found = {}
    for doc, text in by_id.items():
        own, hit, which = words(text), set(), set()
        for item, body in items:
            w = words(body or "")
            size = min(window, len(w))
            grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
            for i in range(len(own) - size + 1 if size else 0):
                if tuple(own[i : i + size]) in grams:
                    hit.update(range(i, i + size))
                    which.add(str(item))
        found[doc] = (len(own), len(hit), hashlib.sha256(",".join(sorted(which)).encode()).hexdigest())
    return found


@pytest.mark.parametrize(("most", "window"), [(1 << 26, 10), (0, 10), (0, 3)])
def test_decontamination(spark, docs, by_id, empty, most, window, monkeypatch):
    """By a broadcast and by a shuffle of the benchmark."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    long = [t for t in by_id.values() if 30 < len(t.split()) < 100][:4]
    items = [(10 + i, " ".join(t.split()[3:25]).upper()) for i, t in enumerate(long)] + [(2, "rain sun"), (3, ""), (4, None), (5, long[0]), (6, "rain sun"), (6, "rain sun"), (7, "étude")]
    benchmark = spark.createDataFrame([(*item, 1, "x") for item in items], "item_id long, text string, doc_id long, items string")
    rows = decontamination.contamination(docs, benchmark, window, carry=("hash", "n")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in rows} == brute_hits(by_id, items, window)
    assert {(r.hash, r.n) for r in rows} == {("h", 2)}
    assert decontamination.contamination(empty, benchmark).count() == 0
    assert decontamination.contamination(docs, benchmark.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_decontamination_keeps_every_row(spark, most, monkeypatch):
    """Null and repeated ids, of equal and of different texts: a row in, a row out."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    texts = [(None, "rain sun"), (None, "no hit"), (None, None), (5, "the rain sun"), (5, "the rain sun"), (5, "cart"), (6, "sun rain sun " * 30_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "rain sun"), (None, "cart")], "item_id long, text string")
    found = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(docs, benchmark).collect())
    assert found == [(False, 5, 1, 1, ["None"]), (False, 5, 3, 2, ["1"]), (False, 5, 3, 2, ["1"]), (False, 6, 90_000, 60_000, ["1"]), (True, None, 0, 0, []), (True, None, 2, 0, []), (True, None, 2, 2, ["1"])]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(9)
    body = lambda lang, k: " ".join(draw.choice(LANGS[lang]) + str(draw.randrange(50)) for _ in range(k))
    clean = [body(lang, 60) for lang in LANGS for _ in range(12)]
    near = clean[0].split()
    near[30] = "changed"
    passage = body("en", 20)
    texts = [*clean, clean[1] + " \n", " ".join(near), body("en", 30) + " " + passage + " " + body("en", 30), None, "12 34"]
    rows = [(i, t, list(LANGS)[min(i, 35) // 12], "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in pieces}) == sorted([0, *range(2, 36), 36])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline_stages_decide_about_rows(spark, tmp_path):
    """Null ids, one id of several texts, repeated rows, clashing names: good rows stay, and one row of each group."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept int, digest string"
    row = lambda i, text: (i, text, "en", "s", len(text or ""), "c", 1, "d")
    frame = lambda rows: spark.createDataFrame([row(*r) for r in rows], kinds)
    left = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    good = [f"{a} these are plain words of a good text that stays {b}" for a, b in ("ab", "cd", "ef", "gh")]
    docs = frame([(None, "12 34"), (None, good[0]), (None, good[1]), (4, "..."), (4, good[2]), (5, None), (6, "")])
    out = corpus_pipeline.identify_languages(spark, docs, "")
    assert out.columns == docs.columns and left(out) == sorted([(None, good[0]), (None, good[1]), (4, good[2])], key=repr)
    docs = frame([(None, good[0]), (None, good[1]), (3, good[2]), (3, good[2]), (3, good[3]), (9, good[1] + " "), (None, good[2]), (None, good[0])])
    out = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert out.columns == docs.columns and left(out) == sorted([(None, good[0]), (9, good[1] + " "), (3, good[2]), (3, good[3])], key=repr)
    long = [" ".join(f"{a}{k}" for k in range(80)) for a in "xyz"]
    docs = frame([(None, long[0]), (7, long[0] + " more"), (8, long[0] + " else"), (None, long[1]), (None, long[1]), (2, long[2]), (2, good[0]), (2, long[2] + " a"), (None, ""), (None, None)])
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    kept = sorted((r.doc_id is None, r.doc_id, (r.text or "").split(" ")[0]) for r in out.collect())
    assert kept == [(False, 2, "a"), (False, 2, "z0"), (False, 7, "x0"), (True, None, ""), (True, None, ""), (True, None, "y0")]
    spark.createDataFrame([(1, "plain words of a good text that stays for ever more", 1)], "item_id long, text string, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    spoiled = "so plain words of a good text that stays for ever more it is"
    docs = frame([(None, spoiled), (None, good[1]), (3, good[2]), (3, spoiled), (3, spoiled), (3, good[3]), (None, None)])
    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and left(out) == sorted([(None, good[1]), (3, good[2]), (3, good[3]), (None, None)], key=repr)
    none = frame([]).select(*docs.columns)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, f"{tmp_path}/none").count() == 0


def test_kernel_ridge_by_dense_matrices():
    """Landmarks, Nystroem features and one-versus-rest ridge regression, each kernel value counted from sets of n-grams."""
    draw, texts, labels = random.Random(11), [], []
    for i in range(60):
        lang = list(LANGS)[i % 3]
        texts.append(language_id.prepared(" ".join(draw.choice(LANGS[lang]) for _ in range(draw.choice([1, 4, 12])))))
        labels.append(lang)
    model = language_id.fit(texts, labels, landmarks=12)

    def bucket(gram):
        number = int.from_bytes(gram, "big")
        return (number * (0x9E3779B1 + 2 * len(gram)) % (1 << 32)) >> 16

    def kept(text):
        return {bucket(text[i : i + n]) for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    sets = [kept(t) for t in texts]
    languages = sorted(set(labels))
    chosen = []
    for lang in languages:
        own = [i for i, x in enumerate(labels) if x == lang]
        chosen += [own[int(k)] for k in np.linspace(0, len(own) - 1, 4).astype(int)]
    kernel = lambda a, b: len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))
    inner = np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen])
    outer = np.array([[kernel(s, sets[j]) for j in chosen] for s in sets])
    values, vectors = np.linalg.eigh(inner)
    root = (vectors / np.sqrt(np.maximum(values, 1e-12)))[:, values > 1e-8 * values.max()]
    features = outer @ root
    y = np.array([[1.0 if x == lang else -1.0 for lang in languages] for x in labels])
    weight = np.diag([1 / labels.count(x) for x in labels])
    solved = np.linalg.solve(features.T @ weight @ features + language_id.RIDGE * np.eye(features.shape[1]), features.T @ weight @ y)
    asked = [*texts[:9], b"", language_id.prepared("the und avec")]
    wanted = np.array([[kernel(kept(t), sets[j]) for j in chosen] for t in asked]) @ root @ solved
    assert np.allclose(model.scores(asked), wanted, atol=2e-3)


def test_additive_model_by_loops():
    """Margins are the base and, bin by bin, the entries of the tables; a cut is the best of all cuts."""
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(300, len(quality.FEATURES)))
    labels = (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0).astype(float)
    model = quality.fit(rows, labels)
    assert model.pairs and (1, 2) in model.pairs
    asked = np.vstack([draw.normal(size=(40, rows.shape[1])), rows[:5]])
    for row, found in zip(asked, model.margins(asked).tolist(), strict=True):
        wanted = model.base
        for k, (edges, table) in enumerate(zip(model.edges, model.tables, strict=True)):
            wanted += table[sum(1 for e in edges if e < row[k])]
        for (a, b), table in model.pairs.items():
            wanted += table[sum(1 for e in model.pair_edges[a] if e < row[a])][sum(1 for e in model.pair_edges[b] if e < row[b])]
        assert abs(found - wanted) < 1e-9
    for _ in range(20):
        g, h = draw.normal(size=9), draw.uniform(0.6, 2, 9)
        gains = {c: g[:c].sum() ** 2 / (h[:c].sum() + 1) + g[c:].sum() ** 2 / (h[c:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) for c in range(1, 9)}
        gain, cut = quality._best_cut(g, h)
        assert abs(gain - max(gains.values())) < 1e-9 and cut == max(gains, key=lambda c: gains[c])


def test_quality_features_by_loops(texts):
    import pyarrow as pa

    found = quality.features_of(pa.array(texts, pa.string()))
    for text, row in zip(texts, found.tolist(), strict=True):
        f, data = dict(zip(quality.FEATURES, row, strict=True)), (text or "").encode()
        words = (text or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w.lower() if w.isascii() else w for w in words if w]
        assert abs(f["log_bytes"] - np.log1p(len(data))) < 1e-9
        assert abs(f["digits"] - sum(48 <= b < 58 for b in data) / max(1, len(data))) < 1e-9
        assert abs(f["non_ascii"] - sum(b > 127 for b in data) / max(1, len(data))) < 1e-9
        lowered = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        assert abs(f["distinct_words"] - len(set(lowered)) / max(1, len(words))) < 1e-9
        assert abs(f["top_word"] - max([lowered.count(w) for w in set(lowered)], default=0) / max(1, len(words))) < 1e-9
        assert abs(f["distinct_pairs"] - len(set(zip(lowered, lowered[1:]))) / max(1, len(words) - 1)) < 1e-9
        assert abs(f["word_bytes"] - sum(len(w.encode()) for w in words) / max(1, len(words))) < 1e-9


def test_character_ngrams_by_sets(spark):
    """Buckets of whole characters, counts by a Spark aggregation, ratios and scores against loops."""
    texts = ["", "ab", "ABCabc", "étude été étude", "日本語テキスト", "x" * 50, "a b\nc\td", "İstanbul 😀😀😀 abc"]
    sets = [{toxicity.bucket_of(t.lower()[i : i + n]) for n in toxicity.LENGTHS for i in range(len(t.lower()) - n + 1)} for t in texts]
    doc, bucket = toxicity.distinct_buckets(texts)
    assert [set(bucket[doc == i].tolist()) for i in range(len(texts))] == sets and len(doc) == sum(map(len, sets))
    docs, labels = labelled(spark)
    model = toxicity.learned(docs, labels)
    drawn = quality.labelled_rows(docs, labels, "toxic", 4, 2, toxicity.TRAIN_DOCS, toxicity.TRAIN_TEXT_BYTES).collect()
    assert {r.doc_id for r in drawn} == {i for i in range(400) if i != 3 and zlib.crc32(str(i).encode()) % 4 != 2}
    seen = {0: {}, 1: {}}
    for r in drawn:
        t = (r.text or "").lower()
        for b in {toxicity.bucket_of(t[i : i + n]) for n in toxicity.LENGTHS for i in range(len(t) - n + 1)}:
            seen[r.label][b] = seen[r.label].get(b, 0) + 1
    size = [sum(r.label == k for r in drawn) for k in (0, 1)]
    both = {b: (seen[0].get(b, 0), seen[1].get(b, 0)) for b in seen[0].keys() | seen[1].keys()}
    spread = {b: abs(t / size[1] - o / size[0]) / np.sqrt((o + t + 1) / sum(size)) for b, (o, t) in both.items() if o + t >= toxicity.LEAST_TEXTS}
    best = sorted(spread, key=lambda b: (-round(spread[b], 9), b))[: toxicity.FEATURES]
    assert set(best[: len(best) // 2]) <= set(model.buckets.tolist()) and len(model.buckets) == min(len(spread), toxicity.FEATURES)
    ratio = toxicity.log_ratios(np.array([both[b][1] for b in model.buckets.tolist()]), np.array([both[b][0] for b in model.buckets.tolist()]), size[1], size[0])
    hand = np.array([np.log((both[b][1] + 0.5) / (size[1] + 1)) - np.log((both[b][0] + 0.5) / (size[0] + 1)) for b in model.buckets.tolist()])
    assert np.allclose(ratio, hand)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    for text, score in zip([r.text for r in drawn[:20]], model.scores([r.text for r in drawn[:20]]), strict=True):
        t = text.lower()
        margin = model.intercept + sum(weight.get(b, 0) for b in {toxicity.bucket_of(t[i : i + n]) for n in toxicity.LENGTHS for i in range(len(t) - n + 1)})
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-4
    again = toxicity.learned(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.buckets, model.buckets) and np.allclose(again.weights, model.weights, atol=1e-5)


def test_neighbours_decide_blocks():
    """The same short line is main text between running text and not between link lists; no element says anything."""
    prose, line = "<div>" + "word " * 40 + "</div>", "<div>some nine words that stand on one single line</div>"
    links = "<ul><li><a href=/x/>one</a></li><li><a href=y>two more</a></li></ul>"
    assert "nine words" in html_extract.main_text(links + prose + line + prose + links)
    assert "nine words" not in html_extract.main_text(links + line + links + prose + prose + links)
    rows, labels = html_extract.labelled_table()
    assert (html_extract.trained_tree().classify(rows) == labels).mean() > 0.95


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<p><i>", "<span></x>", "<a>", "<li><ul>", "<table><td>"])
def test_deep_pages_take_linear_time(unit):
    began = time.process_time()
    assert html_extract.main_text("<article>" + unit * 100_000 + "the text") == "the text"
    assert time.process_time() - began < 5


def test_quotes_and_slashes_in_values():
    assert html_extract.main_text("<article><p data-x=it's>kept text here</p><p a=\"b>c\" d='e>f'>more</p></article>") == "kept text here\nmore"
    assert html_extract.blocks_of("<p><a href=/x/>home page</a> x</p>")[0].linked == 2
    assert html_extract.main_text("<article><span/>a<p class=x/>b</article>") == "a\nb"


def test_step_groups_are_balanced(spark):
    draw = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(draw.choice(WORDS) for _ in range(draw.choice([3, 30, 300, 700, 1500, 5000])))) for i in range(400)], "doc_id long, text string").repartition(5)
    rows = packing.packed(docs, step_tokens=8192).collect()
    tokens_of, tiers = {}, {}
    for r in rows:
        tokens_of[r.step_group] = tokens_of.get(r.step_group, 0) + r.length
        tiers.setdefault(r.step_group, set()).add(r.tier)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, set()).add((r.tier, r.step_group))
    assert all(len(s) == 1 for s in sequences.values())
    total = sum(tokens_of.values())
    assert sorted(tokens_of) == list(range(round(total / 8192))) and len(tokens_of) > 20
    assert max(tokens_of.values()) - min(tokens_of.values()) <= 2 * 2048 and {256, 512, 1024, 2048} <= set.union(*tiers.values())
    assert sum(len(t) > 1 for t in tiers.values()) <= len(set.union(*tiers.values()))


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    """Null and repeated ids, a very long text; files that no row names don't count."""
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(5, "another"), (9, long)], "doc_id long, text string"))
    folder = f"{tmp_path}/ids"
    rows = token_binary.token_files(docs, f"file://{folder}").collect()
    encode = tokens.PartEncoder(tokens.public_path("word_bpe_49k.json")).encode
    sizes = {t: len(encode([t])[0]) // 4 + 1 for t in ("", "a b c d e f", "another", long)}
    spans = sorted((r.start, r.n_tokens, r.doc_id) for r in rows)
    assert gapless([(s, n) for s, n, _ in spans]) and sorted(n for _, n, _ in spans) == sorted([sizes[""], *[sizes["a b c d e f"]] * 3, sizes["another"], sizes[long]])
    assert [d for _, _, d in spans] == [None, None, 5, 5, 5, 9]
    files = token_binary.write_files(docs, f"file://{folder}2", tokens.public_path("word_bpe_49k.json"), 2)
    some = next(iter((tmp_path / "ids2").glob("*.pltk")))
    (tmp_path / "ids2" / "00000000-00000-lost.pltk").write_bytes(some.read_bytes())
    assert token_binary.read_files(spark, f"file://{folder}2", files).count() == 6


@pytest.mark.parametrize("kind", ["null ids", "repeated", "long"])
def test_classifiers_of_odd_rows(spark, kind):
    docs, labels = labelled(spark)
    extra = {"null ids": [(None, "scoundrel x"), (None, None)], "repeated": [(5, "a"), (5, "b"), (5, "b")], "long": [(2000, "rain sun " * 60_000)]}[kind]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    for scored in (quality.scored, toxicity.scored):
        assert scored(more, labels).count() == 400 + len(extra)
    languages = language_docs(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(*e, "en") for e in extra], "doc_id long, text string, lang string"))
    assert language_id.predicted(languages).count() == 243 + len(extra)


def test_repeats_in_a_very_long_text(spark):
    draw = random.Random(13)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(400))
    long = "".join(draw.choice("abcdefgh ") for _ in range(300_000))
    docs = spark.createDataFrame([(1, long[:150_000] + passage + long[150_000:]), (2, "q" + passage + "r"), (2, "q" + passage + "r"), (3, None), (3, None)], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.without_repeats(docs).collect())
    assert found == [(1, 0, 0), (2, 400, 1), (2, 400, 1), (3, 0, 0), (3, 0, 0)]
    pages = spark.createDataFrame([(1, "u", "<article><p>a</article>")] * 2 + [(None, None, "<article>" + "<p>word " * 50_000)], "page_id long, url string, html string")
    assert sorted(r.n_chars for r in html_extract.extracted(pages).collect()) == [1, 1, 249_999]
