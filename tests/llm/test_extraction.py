"""Decontamination, page text, packing, personal data and license scans."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from quotemill.llm import decontaminate, licenses, packing, pii, wrappers
from quotemill.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_dedup import lower

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards boil green tea near old towers. answer: forty two barrels"


def test_leaks_of_the_given_items(spark, small):
    items = table(spark, SMALL, "benchmark")
    flat = {r.doc_id: " ".join(r.text.split()) for r in small.collect()}
    want = {(d, i.item_id) for i in items.collect() for d, t in flat.items() if " ".join(i.text.split()) in t}
    got = decontaminate.decontaminate(small, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 3
    kept = decontaminate.keep_clean(small, items)
    assert kept.columns == small.columns and {r.doc_id for r in kept.collect()} == set(flat) - {d for d, _ in want}


def test_paraphrases_and_odd_rows(spark, odd, none):
    rng = np.random.default_rng(1)

    def noise(n):
        return " ".join(f"w{rng.integers(3000)}" for _ in range(n))

    words = ITEM.split()
    dropped = " ".join(w for i, w in enumerate(words) if i % 8)
    swapped = " ".join("changed" if i % 9 == 4 else w for i, w in enumerate(words))
    docs = [
        (101, f"{noise(500)} {ITEM.upper()} {noise(300)}"), (102, f"{noise(70)} {dropped} {noise(3000)}"), (103, f"{noise(33)} {swapped}"),
        (104, f"{noise(100)} {' '.join(words[:6])} {noise(100)}"), (105, noise(400)), (None, f"{ITEM} {noise(50)}"),
    ]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    items = spark.createDataFrame([(1, ITEM, 0), (1, ITEM, 1), (2, None, 2), (3, "one two", 3), (None, noise(40), 4)], "item_id long, text string, doc_id int")
    for block in (1, 4096):
        got = decontaminate.decontaminate(docs, items, block=block).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (101, 1), (102, 1), (103, 1)]
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.where("false")).count() == 0


def test_latent_candidates_hold_what_exact_cosine_finds(spark, small):
    """Recall of the index: pieces of items against all passages, by brute-force TF-IDF cosine."""
    items = [decontaminate.Item(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    raws = decontaminate.texts(small)
    frequency, count, sample, *_ = decontaminate.statistics(raws, 2000)
    idf = decontaminate.weights(frequency, count)
    terms = decontaminate.Terms()
    pieces = [terms.of(p) for i in items for p in i.pieces]
    space = decontaminate.latent_space(sample, pieces, idf, 256)
    queries = [decontaminate._row(p, idf) for p in pieces]
    latent = np.array([v @ space[t] for t, v in queries])
    found = exact = 0
    for r in raws.collect():
        tokens = decontaminate.words(bytes(r.raw))
        ids = terms.of(tokens)
        if not len(ids):
            continue
        every = np.arange(-(-len(tokens) // decontaminate.BLOCK))
        vectors, size = decontaminate.project(tokens, every, terms, space * idf[:, None], idf)
        near = vectors @ latent.T >= decontaminate.COSINE * np.maximum(size, 1e-9)[:, None]
        for b in range(len(size)):
            t, v = decontaminate._row(ids[b * decontaminate.BLOCK : (b + decontaminate.SPAN) * decontaminate.BLOCK], idf)
            row = np.zeros(decontaminate.WIDTH)
            row[t] = v
            for q, (qt, qv) in enumerate(queries):
                if row[qt] @ qv >= 0.35:
                    exact += 1
                    found += bool(near[b, q])
    assert exact > 10 and found >= 0.9 * exact


def test_leaks_equal_brute_force(spark, small):
    """Every passage against every piece by the common subsequence alone, without an index, a space or a cosine."""
    items = [decontaminate.Item(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.decontaminate(small, table(spark, SMALL, "benchmark")).collect()}
    sure, likely = set(), {}
    for r in small.collect():
        tokens = decontaminate.words((r.text or "").encode())
        for item in items:
            masks, own = [decontaminate.places(p) for p in item.pieces], set(item.tokens)
            if sum(w in own for w in set(tokens)) < 0.3 * len(own):
                continue
            best = [
                max((decontaminate.common(m, len(p), tokens[at : at + 96]) for at in range(0, len(tokens), 32)), default=0)
                for m, p in zip(masks, item.pieces)
            ]
            covered = sum(best) / len(item.tokens)
            if covered >= decontaminate.SURE:
                sure.add((r.doc_id, item.item_id))
            if covered >= decontaminate.LIKELY:
                likely[r.doc_id, item.item_id] = sum(best)
    assert sure and sure <= set(got)
    assert all(likely.get(k) == matched for k, matched in got.items())


def test_statistics_count_documents(spark, small, monkeypatch):
    """Counts from hashes, part by part, are the plain ones."""
    raws, vocabulary = decontaminate.texts(small), frozenset([b"the", b"of", b"absent"])
    texts = [decontaminate.words(bytes(r.raw)) for r in raws.collect()]
    monkeypatch.setattr(decontaminate, "HASHED", 50)
    frequency, count, _, seen, _ = decontaminate.statistics(raws, 100, vocabulary)
    terms, want = decontaminate.Terms(), np.zeros(decontaminate.WIDTH)
    for t in texts:
        want[np.unique(terms.of(t))] += 1
    assert count == len(texts) and (frequency == want).all()
    assert seen(b"the") == sum(t.count(b"the") for t in texts) > 0 and seen(b"absent") == 0


def test_every_passage_of_every_text_shapes_the_space(spark, small):
    raws = decontaminate.texts(small)
    frequency, _, sketch, _, passages = decontaminate.statistics(raws, 100)
    rows = np.array([np.frombuffer(r.part, np.float32) for r in sketch.collect()])
    assert rows.shape == (100, decontaminate.WIDTH)
    assert (rows.any(axis=0) == (frequency > 0)).all()
    assert len(passages) == sum(-(-len(decontaminate.words(bytes(r.raw))) // decontaminate.BLOCK) for r in raws.collect())


def test_folded_passages_keep_their_products(monkeypatch):
    """With rows to spare every passage has a row of its own, and the products are those of all passages."""
    monkeypatch.setattr(decontaminate, "WIDTH", 64)
    monkeypatch.setattr(decontaminate, "FOLD", 7)
    rng = np.random.default_rng(6)
    texts, idf = [rng.integers(0, 64, n) for n in (1, 31, 33, 500, 96)], rng.uniform(0.1, 3, 64).astype(np.float32)
    want = np.zeros((64, 64))
    for terms in texts:
        for at in range(0, len(terms), decontaminate.BLOCK):
            t, v = decontaminate._row(terms[at : at + decontaminate.BLOCK * decontaminate.SPAN], idf)
            want[np.ix_(t, t)] += np.outer(v, v)
    total = np.zeros((1 << 16, 64), np.float32)
    decontaminate.fold(total, np.arange(5) * 1000, [t.astype("<u2").tobytes() for t in texts], idf)
    assert np.allclose(total.T @ total, want, atol=1e-4)
    # Few rows: each has passages of its own, with either sign.
    total = np.zeros((2, 64), np.float32)
    decontaminate.fold(total, np.arange(5) * 1000, [t.astype("<u2").tobytes() for t in texts], idf)
    assert total.any(axis=1).all() and (total < 0).any() and (total > 0).any()


def test_space_holds_directions_that_only_the_passages_have(spark):
    """Rows of the sketch count in full beside the pieces: the space spans both."""
    rng = np.random.default_rng(8)
    dense = np.zeros((6, decontaminate.WIDTH), np.float32)
    dense[:, 100:140] = rng.standard_normal((6, 40)) * 100
    sketch = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(dense)], "row int, part binary")
    pieces, idf = [np.array([1, 2, 3]), np.array([4, 5, 5])], np.ones(decontaminate.WIDTH, np.float32)
    space = decontaminate.latent_space(sketch, pieces, idf, 20)
    assert space.shape == (decontaminate.WIDTH, 8)
    for row in [*dense / np.linalg.norm(dense, axis=1)[:, None], np.bincount([1, 2, 3], minlength=decontaminate.WIDTH) / math.sqrt(3)]:
        assert np.linalg.norm(row @ space) > 0.999


@pytest.mark.parametrize("words", [64, 1 << 12])
def test_products_of_all_passages(monkeypatch, words):
    """Block by block, and long texts part by part, every passage counts once, with its own length."""
    for name, value in (("WIDTH", 64), ("CHUNK", 128), ("MULTIPLIED", words), ("READ", 64)):
        monkeypatch.setattr(decontaminate, name, value)
    rng = np.random.default_rng(6)
    texts, idf = [rng.integers(0, 64, n) for n in (1, 31, 32, 33, 64, 65, 96, 97, 128, 129, 192, 193, 1000)], rng.uniform(0.1, 3, 64).astype(np.float32)
    texts.append(np.full(300, 7))
    want = np.zeros((64, 64))
    for terms in texts:
        for at in range(0, len(terms), decontaminate.BLOCK):
            t, v = decontaminate._row(terms[at : at + decontaminate.BLOCK * decontaminate.SPAN], idf)
            want[np.ix_(t, t)] += np.outer(v, v)
    w, total = rng.standard_normal((64, 5)).astype(np.float32), np.zeros((64, 5), np.float32)
    decontaminate.multiply(total, [t.astype("<u2").tobytes() for t in texts], np.append(w * idf[:, None], np.zeros((1, 5), np.float32), axis=0), idf)
    assert np.allclose(total * idf[:, None], want @ w, atol=1e-3)


def test_pipeline_fits_its_space_on_the_passages_themselves(spark, small, monkeypatch):
    """The space of the pipeline's stage holds what the best one of its rank does; that of the sketch alone does not."""
    import corpus_pipeline

    asked = {}

    def noted(sketch, pieces, idf, rank, **options):
        asked.update(sketch=sketch, pieces=pieces, idf=idf, rank=rank, options=options)
        return asked.setdefault("space", space(sketch, pieces, idf, rank, **options))

    space = decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", noted)
    corpus_pipeline.decontamination(spark, small, SMALL)
    terms, idf, rows = decontaminate.Terms(), asked["idf"], []
    for r in small.collect():
        ids = terms.of(decontaminate.words((r.text or "").encode()))
        rows += [decontaminate._row(ids[at : at + decontaminate.SPAN * decontaminate.BLOCK], idf) for at in range(0, len(ids), decontaminate.BLOCK)]
    lift = math.sqrt(decontaminate.WEIGHT / len(asked["pieces"]))
    assert len(rows) < decontaminate.WEIGHT and len(asked["pieces"]) < decontaminate.RANK
    rows += [(t, v * lift) for t, v in (decontaminate._row(p, idf) for p in asked["pieces"])]
    a = np.zeros((len(rows), decontaminate.WIDTH), np.float32)
    for i, (t, v) in enumerate(rows):
        a[i, t] = v
    best = np.linalg.eigvalsh((a @ a.T).astype(np.float64))[-asked["rank"] :].sum()
    assert np.square(a @ asked["space"]).sum() > 0.97 * best
    sketch_only = space(asked["sketch"], asked["pieces"], idf, asked["rank"])
    assert np.square(a @ sketch_only).sum() < np.square(a @ asked["space"]).sum()


def test_hashes_of_texts_are_those_of_words(monkeypatch):
    texts = [b"", b"   ", b"a", b" a  bc def ", b"x" * 700 + b" y " + b"z" * 90, bytes(range(256)) * 3]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(decontaminate, "HASHED", size)
        for raw in texts:
            got = [int(h) for part in decontaminate.hashes(decontaminate.spaced(raw)) for h in part]
            assert got == [decontaminate.word_hash(w) for w in decontaminate.words(raw)]


def test_long_answers_count_whole():
    item = decontaminate.Item(1, "Short question? " + " ".join(f"a{k}" for k in range(200)))
    assert len(item.answer) == 200


def test_thousands_of_items_are_found(spark, small):
    """More pieces than the space has directions: every span of a document leaks into it."""
    rng = np.random.default_rng(3)
    docs = [(r.doc_id, r.text.split()) for r in small.collect() if r.text and len(r.text.split()) > 70]
    items, want = [], set()
    for i in range(2000):
        doc_id, tokens = docs[rng.integers(len(docs))]
        n = int(rng.integers(15, 60))
        at = int(rng.integers(len(tokens) - n))
        item = decontaminate.Item(i, " ".join(tokens[at : at + n]))
        if len(item.tokens) >= decontaminate.LEAST and len(item.pieces) == 1:
            items.append((i, " ".join(tokens[at : at + n])))
            want.add((doc_id, i))
    assert len(want) > 1800
    got = decontaminate.decontaminate(small, spark.createDataFrame(items, "item_id long, text string"))
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_shared_words_find_all_that_brute_force_finds():
    rng = np.random.default_rng(4)

    def text(n):
        return [b"w%d" % int(x) for x in rng.zipf(1.3, n) % 400]

    pieces = [text(int(rng.integers(5, 65))) for _ in range(300)]
    seen = rng.integers(0, 50, 400).tolist()
    shared = decontaminate.Shared(pieces, 0.6, lambda w: seen[int(w[1:])], [text(96) for _ in range(50)])
    assert len(set(shared.least.tolist())) > 2
    least = 0
    for _ in range(20):
        tokens = text(150)
        for q in rng.integers(len(pieces), size=4):
            at = int(rng.integers(len(tokens)))
            tokens[at:at] = [w for w in pieces[q] if rng.random() < 0.75]
        want = set()
        for block in range(-(-len(tokens) // decontaminate.BLOCK)):
            passage = tokens[block * decontaminate.BLOCK : (block + decontaminate.SPAN) * decontaminate.BLOCK]
            for q, piece in enumerate(pieces):
                if decontaminate.common(decontaminate.places(piece), len(piece), passage) >= 0.6 * len(piece):
                    want.add((block, q))
        got = set(zip(*(x.tolist() for x in shared.passages(tokens))))
        assert want <= got
        least += len(want)
    assert least > 50
    assert not len(shared.passages([])[0])


def test_common_subsequence():
    a, b = list("abcbdab"), list("bdcaba")
    assert decontaminate.common(decontaminate.places(a), len(a), b) == 4


PAGE = """<html><head><title>t</title><script>if (a<b) "</p>"</script></head><body><header><h2>Site</h2></header><nav><a href=/x>{0}</a></nav>
<div class="cookie-notice">We use cookies {0}</div><aside>side {0}</aside><form>search {0}<input></form>
<{1}><h1>Title {0}</h1><p>First &amp;amp; <b>bold</b>
 text&nbsp;{0}<br>more<p>Second {0}</p><ul><li>one {0}<li>two</ul><div class="ad">buy {0}</div><pre>code   {0}</pre></{1}>
<div id="comments"><p>I disagree {0}</p></div><footer>&copy; {0}</footer>"""


@pytest.mark.parametrize("tag", ["article", "main", 'div class="post-content"', "div"])
def test_page_text(spark, none, tag):
    end = tag.split(" ")[0]
    page = PAGE.replace("<{1}>", f"<{tag}>").replace("{1}", end)
    rows = [(i, f"http://host{i % 3}.example/p/{i}", page.replace("{0}", f"words number {i} " * (3 + i))) for i in range(15)]
    rows += [(50, None, None), (51, "http://host1.example/", ""), (52, "no url", "just text"), (None, "http://h/", "<p>x"), (3, *rows[3][1:])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = wrappers.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        if r.page_id is not None and r.page_id < 50:
            w = f"words number {r.page_id} " * (3 + r.page_id)
            want = [f"Title {w}", f"First &amp; bold text {w}more", f"Second {w}", f"one {w}", "two", f"code {w}"]
            assert r.text == "\n".join(x.strip() for x in want)
    assert {r.page_id: r.text for r in got if r.page_id in (50, 51)} == {50: "", 51: ""}
    assert wrappers.main_text(pages.where("false")).count() == 0


def test_given_pages(spark):
    import html

    for r in wrappers.main_text(table(spark, SMALL, "pages")).join(table(spark, SMALL, "pages").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_layouts_absent_from_the_sample_keep_their_article(spark):
    layouts = ['div class="post-content"', "article", 'section class="guide"', "main", 'div id="review"', 'td class="cell"']

    def page(i, tag):
        name = tag.split(" ")[0]
        head = '<div class="site">The same line everywhere</div><nav>home</nav>'
        return f"<body>{head}<{tag}><h1>{f'Title {i} ' * 15}</h1><p>{f'words number {i} ' * 9}</p></{name}><footer>end</footer>"

    rows = [(i, "http://big.example/", page(i, layouts[0] if i % 50 else layouts[1 + i // 50 % 5])) for i in range(400)]
    rows += [(i, "http://mixed.example/", page(i, layouts[i == 403])) for i in range(400, 412)]
    rows += [(i, None, page(i, f'div class="{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}box"')) for i in range(500, 540)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, url, _ in rows:
        assert f"{f'Title {i} ' * 15}".strip() + f"\nwords number {i} " in got[i] and got[i].count(f"number {i}") == 9
        assert url is None or "same line" not in got[i]


def test_tree_matching_and_deep_pages():
    a, b = (wrappers.parse(p)[0] for p in ("<div><p>1<p>2<ul><li>3</ul></div>", "<div><h1>0</h1><p>1</p></div><i>x</i>"))
    assert wrappers.match(a, b, {}) == 3  # html, div, p
    deep = "<div>" * 5000 + "<p>text" + "</div>" * 5000 + "<p>after"
    assert wrappers.extract(deep, wrappers.induce([deep]), {}) == "text\nafter"


def check_pieces(docs, got):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[(r.doc_id, len(ids), np.array(ids, dtype="<u4").tobytes())] += 1
    # Pieces follow each other in their document, also where rows repeat.
    by_doc, sequences = {}, {}
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    found = Counter()
    for i, pieces in by_doc.items():
        rest = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
        while rest:
            at, out, n = 0, b"", None
            for r in list(rest):
                if r.start == at and n in (None, r.doc_tokens) and at < r.doc_tokens:
                    n, at, out = r.doc_tokens, at + r.length, out + bytes(r.ids)
                    rest.remove(r)
                if n is not None and at == n:
                    break
            assert at == n
            found[(i, n, out)] += 1
    assert found == want
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= rows[0].window <= 2048 and len({r.step_id for r in rows}) == 1
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


@pytest.mark.parametrize("name", ["small", "odd", "none"])
@pytest.mark.parametrize("chars", [1 << 20, 1 << 12])
def test_packing(request, name, chars):
    docs = request.getfixturevalue(name)
    got = packing.pack(docs, group_chars=chars).collect()
    padding = check_pieces(docs, got)
    groups = {r.sequence_id >> 32 for r in got}
    assert padding <= 2048 * len(groups)


def test_special_tokens_keep_their_case(spark):
    texts = ["a <|endoftext|> b", "A <|ENDOFTEXT|> B", "x<|EndOfText|>y <|startoftext|>", "CAPS only"]
    check_pieces(docs := spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.pack(docs).collect())


def test_words_with_signs_are_put_together_from_their_parts(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    texts = ["word.%%% word,### (a1b22) \u00c9t\u00e9... x_y--z", "End. Mid.dle , \u00f6. a.\n.b", "", "it's <|endoftext|>A. \u4e2d\u6587. b"]
    monkeypatch.setattr(packing, "CACHE", 3)
    own = packing.Encoder(packing.vocabulary())
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.batch([t.encode() for t in texts])] == want
    assert len(own) <= 3 and len(own.old) <= 3
    # Simple chunks never take the slow way through the whole tokenizer.
    own = packing.Encoder(packing.vocabulary())
    own.tokenizer = None
    assert [np.frombuffer(x, "<u2").tolist() for x in own.batch([t.encode() for t in texts[:1]])] == want[:1]


def test_rows_without_an_id_of_their_own_are_dealt_over_groups(spark):
    rows = [(None, f"some words of text {i} " * 20) for i in range(300)] + [(7, "the same words again " * 20)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = packing.pack(docs, group_chars=1 << 13).collect()
    check_pieces(docs, got)
    tokens = Counter()
    for r in got:
        tokens[r.doc_id, r.sequence_id >> 32] += r.length
    for key in (None, 7):
        sizes = [n for (i, _), n in tokens.items() if i == key]
        assert len(sizes) > 15 and max(sizes) < 0.2 * sum(sizes)


def test_tiers_are_filled_from_shorter_ones():
    counts = np.array([3000, 1500, 700, 300, 100, 100])
    starts, sizes, tier = packing.layout(counts)
    assert tier.tolist() == [2048, 2048, 1024, 512, 256, 256]
    assert sizes.tolist() == [2048, 2048, 2048] and starts.tolist() == [0, 2048, 4096]
    with pytest.raises(ValueError):
        packing.pack(None, tiers=(1000, 500))


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def digits(s):
        return [int(c) for c in s if c in "0123456789"]

    def passes(kind, s):
        d = digits(s)[::-1]
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    spans = [(m.start(), k, m.end(), kind) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if passes(kind, m[0])]
    return [(kind, a, b) for a, _, b, kind in sorted(spans)]


TRICKY = [
    "a@b.c_x@y.z a@b.c.@d.e @x.y a@b a@b..c +@b.c x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4 99999999999.1.1.1 1.2.3", "4111 1111-1111 1111 4111111111111112 0-0",
    "+1 (555) 123-4567 +12 +1(((((( +123456789012345678 ++49 30 1234567", "\U0001f600 é a@b.c \U0001f600 4111111111111111", "1" * 3000 + " " + "a@b.c " * 1300, "+1 555 0100 200.1.2.3",
]


@pytest.mark.parametrize("name", ["small", "odd", "none", "tricky"])
def test_personal_data(request, spark, name):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if name == "tricky" else request.getfixturevalue(name)
    texts = Counter((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    found = pii.find_pii(docs)
    want = Counter()
    for (i, t), n in texts.items():
        spans = plain_spans(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want[(i, *[sum(s[0] == k for s in spans) for k in RULES], hashlib.sha256(said.encode()).hexdigest(), said)] += n
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found.collect()) == want


def test_contexts_find_unseen_numbers(spark):
    texts = [f"please call hotline +1 (555) 100-{i:04d} now" for i in range(20)]
    texts += ["please call hotline 555-867-5309 now", "item number 555-867-5310 now", "call hotline x1 now"]
    texts += [f"item number {i}00{i}55 now" for i in range(5)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[20].spans == "phone:20:32" and got[20].n_phone == 0 and texts[20][20:32] == "555-867-5309"
    assert all(got[i].spans == "" for i in range(21, 28)) and got[0].n_phone == 1


def test_contexts_reach_over_long_gaps(spark):
    """Long neighbours and runs of white space are read whole, and cost no more than their length."""
    long, wide = "x" * 300, " " * 500
    texts = [f"{long} hotline{wide}+1 (555) 100-{i:04d}{wide}now" for i in range(20)] + [f"{long} hotline{wide}555-867-5309{wide}now"]
    texts.append("a" * 200_000 + " 1 " + "b " * 50_000 + "2")
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    at = texts[20].index("555-867")
    assert got[20].spans == f"phone:{at}:{at + 12}" and got[21].spans == ""


def test_personal_data_is_native(spark, small):
    rows = pii.with_base(small)
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["small", "odd", "none"])
def test_licenses(request, name):
    docs = request.getfixturevalue(name)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        at = [(i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        places = [i for i, _ in at]
        want[(r.doc_id, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))] += 1
    got = licenses.scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def plain_matches(line):
    """All rules tried, and suppression by comparing with everything taken."""
    found = [(m.start(), m.end(), n) for n, rule in enumerate(licenses.RULES) for m in rule.pattern.finditer(line)]
    found.sort(key=lambda m: (-licenses.RULES[m[2]].priority, m[0] - m[1], m[0], m[2]))
    taken = []
    for m in found:
        if not any(a <= m[0] and m[1] <= b for a, b, _ in taken):
            taken.append(m)
    return sorted((a, b, licenses.RULES[n].label) for a, b, n in taken)


NOTICES = {
    "Licensed under the Apache License, Version 2.0 (the License)": "apache-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
    "GNU Lesser General Public License v2.1 or any later version": "gpl,lgpl-2.1",
    "licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa-4.0",
    "This work is in the public domain; CC0 1.0": "cc0,public-domain",
    "released under the MIT license, all rights reserved": "mit,reserved",
    "wir gehen mit dem php elastic isc": "",
}


def test_many_matches_in_one_text(spark):
    """Work grows with the matches, not with their square."""
    n = 80_000
    text = "cc by all rights reserved " * (n // 2)
    start = time.perf_counter()
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)).first()
    assert time.perf_counter() - start < 20
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (n // 2 * 5, n, 0, n // 2 * 5 - 3)
    small = " " + "cc by all rights reserved " * 30
    assert [(a, b, r.label) for a, b, r in licenses.rule_matches(small, licenses.automaton())] == plain_matches(small)
    assert [(m.start, m.end) for m in row.matches[:2]] == [(0, 2), (2, 5)]


def test_rules_suppress_and_gate(spark):
    gate = licenses.automaton()
    assert len(licenses.RULES) > 300
    for text in [*NOTICES, " ".join(NOTICES)]:
        line = (b" " + b" ".join(licenses.words(text.encode())) + b" ").decode("latin-1")
        assert sorted((a, b, r.label) for a, b, r in licenses.rule_matches(line, gate)) == plain_matches(line)
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.scan(docs).collect()} == dict(enumerate(NOTICES.values()))


@pytest.mark.parametrize("name, label", [("MIT", "mit"), ("ISC", "isc"), ("X11", "mit"), ("Zlib", "zlib"), ("OpenSSL", "openssl"), ("BSD-3-Clause", "bsd-3-clause"), ("Apache-2.0", "apache-2.0")])
def test_identifiers_name_a_license_without_a_version(name, label):
    line = (b" " + b" ".join(licenses.words(f"// SPDX-License-Identifier: {name} */".encode())) + b" ").decode("latin-1")
    assert [r.label for _, _, r in licenses.rule_matches(line, licenses.automaton())] == [label]
