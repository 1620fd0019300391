"""Operators next to brute force on small tables, and the cases their docstrings define."""

import base64
import bisect
import functools
import hashlib
import json
import random
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymill.llm import bpe, chunks, common, components, embeddings, html_wrappers, langid, licenses, line_dedup, packing, quality, rans, simhash
from tallymill.session import fresh_path

DIRECTORY = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
MANY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASHING = ["fp", "doc", "key", "shard", "gone", "_doc", "_gone", "_cleaned", "_lang", "_ledger", "n_words", "length", "rank", "node", "root", "host", "cell"]


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows and a very long text."""
    line = "a line that two documents hold"
    long_text = " ".join(f"word{i % 977} and" for i in range(60_000))
    return [(1, f"{line}\nonly here {line}"), (2, f"  {line.upper()}\t\nshort\nonly here {line}"), (2, f"{line}\n"), (3, None), (4, ""), (5, " \n\t\n"),
            (None, line), (None, "no id and nothing else"), (6, long_text), (7, long_text), (7, long_text), (8, "Ünïcode çà ñ ß! 123 \x1c   end"),
            (9, "x"), (10, "don't  stop\n\n\n  'll ...  "), (11, "<|endoftext|> is text"), (12, "é" * 9), (13, "é" * 9), (14, "é" * 10), (15, "é" * 10)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "en", None, None) for d, t in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIRECTORY}/documents.parquet")


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# --- token ids by chunks ------------------------------------------------------------------------

ODD_PIECES = ["İ", "ẞ", "Ⱥ", "ß", "ﬁ", "Ǆ", "ς", "Σ", "Å", "é", "é", "́", "ͅ", "가", "½", "²", "①", "ª", "µ", "İstanbul", "STRAẞE", "Don't", "'LL", "...",
              "!?", ".", ",", "\t", "\u3000", "\xa0", "\u200b", "\x1c", "\r\n", "\n", "\n\n", " ", "   ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext|",
              "word", "Hello", "x", "12", "日本", "😀", "_", "ÀÉ", "\x00", "\x85", "Ÿ", "ŉ"]


@pytest.mark.parametrize("special_as_text", [False, True])
@pytest.mark.parametrize("file, attached", [(WORDS, False), (BYTES, True)])
def test_token_ids_equal_whole_text_encoding(file, attached, special_as_text):
    """Texts of case-changing, combining and special strings, in batches of any size and order."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    texts = ["STRAẞE", "İstanbul", ""]
    for _ in range(10_000):
        between = rng.choice([" ", "", None])
        texts.append("".join(rng.choice(ODD_PIECES) + (rng.choice(["", " ", "\n"]) if between is None else between) for _ in range(rng.randrange(14))))
    library = Tokenizer.from_file(file)
    library.encode_special_tokens = special_as_text
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    tokenizer = chunks.FileTokenizer(file, special_as_text)
    encoder = chunks.ChunkEncoder(tokenizer, attached, 20_000, tokenizer.specials)
    order, at = rng.sample(range(len(texts)), len(texts)), 0
    while at < len(order):
        part = order[at:at + rng.choice([1, 7, 300, 3000])]
        assert encoder.encode([texts[i] for i in part]) == [expected[i] for i in part]
        at += len(part)


# --- components ---------------------------------------------------------------------------------

def test_components_equal_a_plain_search(spark):
    random.seed(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = sorted((n, find(n)) for n in parent if find(n) != n)
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted((r["node"], r["root"]) for r in found if r["node"] != r["root"]) == expected


# --- main text ----------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body><header>Top</header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; shoulders</h1><p>One <b>bold</b>&nbsp;word<br>more
<p>Two<script>var a = "</p><p>no";</script></p><ul><li>x<li>y</ul><div class="comments"><p>I say</p></div><form>Mail <input></form></article>
<aside>Side</aside><div class="ad">Buy</div><footer>&copy; me</footer>"""


def test_main_text_of_one_page():
    assert html_wrappers.main_text(PAGE, None) == "Head & shoulders\nOne bold word more\nTwo\nx\ny"


def test_wrapper_has_slots_options_and_groups():
    one = html_wrappers.wrapper_of(html_wrappers.parse("<div><h1>Same</h1><p>a</p><p>b</p><table></table></div>"))
    two = html_wrappers.wrapper_of(html_wrappers.parse("<div><h1>Same</h1><p>c</p><hr><ul><li>i</ul></div>"))
    assert html_wrappers.expression(html_wrappers.aligned(one, two)) == '(div(h1("Same") p(#)+ ul(li("i"))? table()?))' or \
        html_wrappers.expression(html_wrappers.aligned(one, two)) == '(div(h1("Same") p(#)+ table()? ul(li("i"))?))'


def test_host_statistics_find_the_article_without_an_article_element():
    def page(i):
        return (f"<body><div id=top><a href=/>Home</a> Our site</div><div id=content><p>Please log in first</p><p>{'text %d ' % i * 30}</p>"
                f"<p>{'more %d ' % i * 20}</p></div><div id=bottom>All rights reserved</div></body>")

    wrapper = html_wrappers.wrapper_of(html_wrappers.parse(page(0)))
    for i in range(1, 8):
        wrapper = html_wrappers.aligned(wrapper, html_wrappers.wrapper_of(html_wrappers.parse(page(i))))
    text = html_wrappers.main_text(page(3), html_wrappers.region_of(wrapper))
    assert "text 3" in text and "more 3" in text and "Home" not in text and "rights" not in text


def host_wrapper(pages):
    """The wrapper of some pages as tasks and branches would make it, three pages a task."""
    own = [html_wrappers.wrapper_of(html_wrappers.parse(p)) for p in pages]
    tasks = [functools.reduce(html_wrappers.aligned, own[i:i + 3]) for i in range(0, len(own), 3)]
    return json.loads(json.dumps(functools.reduce(html_wrappers.aligned, tasks)))


@pytest.mark.parametrize("opening", ['<div class="content has-sidebar">', '<div class="layout no-banner">', '<main class="with-widgets widget-free">', '<div class="sidebar">'])
def test_one_word_does_not_set_the_article_apart(opening):
    """The last one is hinted to be apart, yet it holds the article element."""
    html = f"<body>{opening}<article><h1>T</h1><p>text</p></article></div></main></body>"
    assert html_wrappers.main_text(html, None) == "T\ntext"
    assert html_wrappers.main_text(html, html_wrappers.region_of(host_wrapper([html] * 5))) == "T\ntext"


def test_anchors_with_such_words_stay_and_parts_beside_go():
    html = ("<article><h1>T</h1><h2 id=related-work>Related work</h2><p>a</p><section id=social-effects><p>b</p></section><h2 id=search>Search</h2>"
            "<section id=notice-of-meeting>c</section><div class='social-share'>Share</div><div class=relatedPosts>More</div><ol id=user-comments><li>I say</ol></article>"
            "<section class=comments><article>You say</article></section>")
    assert html_wrappers.main_text(html, None) == "T\nRelated work\na\nb\nSearch\nc"


@pytest.mark.parametrize("pages", [2, 3, 6, 40])
def test_constants_go_at_their_own_place_whatever_the_number_of_pages(pages):
    """Long notices go, equal headings and quotations and what stands between the texts stay."""
    notice, words = "All rights are reserved and more. " * 20, "alpha beta gamma delta epsilon zeta eta theta".split()

    def page(i):
        body = " ".join(words[(i + k * k) % 8] for k in range(60))
        return (f"<body><div id=content><div class=hello>Please log in first</div><div class=t><h2>Summary</h2><p>{body} {i}</p><blockquote>Shared words</blockquote>"
                f"<p>Please log in first</p><p>{i} {body}</p></div><div class=legal>{notice}</div></div></body>"), f"Summary\n{body} {i}\nShared words\nPlease log in first\n{i} {body}"

    region = html_wrappers.region_of(host_wrapper([page(i)[0] for i in range(pages)]))
    assert all(html_wrappers.main_text(page(i)[0], region) == page(i)[1] for i in range(pages))


def slugged_page(i):
    """A page whose ids and classes are words of its own, and the text that it should give."""
    rng = random.Random(i)

    def word():
        return "".join(rng.choice("abcdefghij") for _ in range(7))

    blocks, text = [], []
    for _ in range(rng.randrange(3, 12)):
        kind = rng.choice(("h2", "p", "ul", "blockquote", "div"))
        own = f"{word()} {word()} {rng.randrange(99)}"
        blocks.append({"h2": f'<h2 id="how-to-{word()}">{own}</h2>', "p": f"<p>{own}</p>", "ul": f'<ul class="{word()}"><li>{own}<li>x</ul>',
                       "blockquote": f"<blockquote>{own}</blockquote>", "div": f'<div id="{word()}" class="{word()} {word()}"><p>{own}</p></div>'}[kind])
        text.extend([own, "x"] if kind == "ul" else [own])
    lead = f"{word()} " * 60
    return (f'<body class="{word()}"><div id="top"><a href=/>Home</a> Our site</div><div id="{word()}-title" class="story {word()}"><p>{lead}</p>{"".join(blocks)}</div>'
            f'<div class="side-{word()} sidebar">Short notes {word()}</div></body>'), "\n".join([lead.strip(), *text])


def test_wrappers_of_slugged_pages_do_not_grow_with_the_pages():
    sizes = {n: len(json.dumps(host_wrapper([slugged_page(i)[0] for i in range(n)]))) for n in (50, 200, 800)}
    assert sizes[800] < 1.5 * sizes[50] and sizes[800] < 40_000


@pytest.mark.parametrize("pages", [1, 2, 3, 9, 30])
def test_slugged_pages_are_read_alike_on_small_and_large_hosts(pages):
    region = html_wrappers.region_of(host_wrapper([slugged_page(i)[0] for i in range(pages)]))
    assert all(html_wrappers.main_text(slugged_page(i)[0], region) == slugged_page(i)[1] for i in range(pages))


def test_extracted_texts_equal_the_generated_ones(spark):
    rows = [(i, f"https://s{i % 2}.example/{i}", *slugged_page(i)) for i in range(240)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, html string").repartition(7)
    found = {r["page_id"]: r["text"] for r in html_wrappers.extract(pages).collect()}
    wrong = [i for i, _, _, text in rows if found[i] != text]
    assert not wrong, (len(wrong), rows[wrong[0]][2], found[wrong[0]], rows[wrong[0]][3])


@pytest.mark.parametrize("html", ["", "   ", "plain words", "<", "<p", "<!-- open", "<script>open", "<div>" * 5000 + "deep", "</p></div>", '<a title="open>x', "<p>" * 3000])
def test_broken_pages_do_not_crash(html):
    assert isinstance(html_wrappers.main_text(html, None), str)


@pytest.mark.parametrize("deep", [10, 195, 250, 5000])
def test_deep_elements_close_their_own(deep):
    inner = "<nav><ul><li>a menu</ul></nav><p>inside</p><aside>an advert</aside>"
    html = f"<body><article><h1>Title</h1>{'<div>' * deep}{inner}{'</div>' * deep}<p>after</p></article><div>outside</div></body>"
    assert html_wrappers.main_text(html, None) == "Title\ninside\nafter"
    assert html_wrappers.main_text(f"<article><div><div>{'<section>' * deep}text{'</section>' * deep}</div><p>more</p></div><p>end</p></article>", None) == "text\nmore\nend"


def test_extract_odd_pages(spark):
    rows = [(1, "https://a.example/x", PAGE), (1, "https://a.example/x", PAGE), (2, None, PAGE), (3, "not a url", None), (None, "http://A.example:80/y", ""), (4, "http://b.example", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("host", "region", "text", "wrapper")})
    found = html_wrappers.extract(pages).collect()
    assert len(found) == 6 and {r["page_id"]: r["n_chars"] for r in found}[4] == 200_000
    assert sum(r["text"] == "Head & shoulders\nOne bold word more\nTwo\nx\ny" for r in found) == 3
    assert html_wrappers.extract(pages.limit(0)).count() == 0


# --- language -----------------------------------------------------------------------------------

def test_language_of_held_out_documents(documents):
    known = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in langid.identify(documents).collect() if r["held_out"]]
    assert rows and np.mean([known[r["doc_id"]] == r["lang_pred"] for r in rows]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_texts_without_a_letter_have_no_language(spark):
    labelled = spark.createDataFrame([(i, "en", "the cat ½ ² ① sat") for i in range(9)] + [(20, "fr", "le chat ½ dort")], "doc_id bigint, lang string, text string")
    model = langid.learn(labelled)
    signs = ["½", "² ³", "①②", "12 ½", "Ⅷ", "७", "_", "…", ""]
    rows = spark.createDataFrame([(s,) for s in [*signs, "x²the½cat", "the cat"]], "text string")
    found = {r["text"]: tuple(r["_lang"]) for r in langid.predictions(rows, model).collect()}
    assert all(found[s] == ("und", 0.0) for s in signs)
    assert found["x²the½cat"][0] == found["the cat"][0] == "en"
    assert not any(set(w) & set("½²①") for w in model.words) and not any(set(g) & set("½²①") for g in model.grams)


def test_language_of_odd_texts(spark, odd):
    found = langid.identify(odd).collect()
    assert len(found) == len(odd_rows())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (3, 4, 5))
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 6)} == {"en"}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    model = langid.Model(["a", "b"], {"word": 0}, {"ab": 1, "z": 2}, np.array([[-1, -7], [-7, -1], [-2, -7]], np.float32))
    assert model.predict("word")[0] == "a" and model.predict("xxab")[0] == "b" and model.predict("zq")[0] == "a" and model.predict("12 !")[0] == "und"


# --- lines --------------------------------------------------------------------------------------

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_line_dedup(rows):
    last = 2**63 - 1
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(SPACE).translate(LOWER)
            if len(key) >= 10:
                holders.setdefault(key, set()).add(last if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(line.strip(SPACE).translate(LOWER), ())
            if len(own) < 2 or min(own) == (last if doc is None else doc):
                kept.append(line)
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_of_odd_texts(odd):
    found = line_dedup.dedup_lines(odd)
    assert found.columns == [*odd.columns, "_n_lines", "_n_dropped"]
    assert rows_of(found, "doc_id", "text", "_n_lines", "_n_dropped") == plain_line_dedup(odd_rows())
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_minimal_perfect_hash_numbers_every_key_once():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, np.uint64))
    levels = line_dedup.build_hash(keys)
    assert sorted(line_dedup.look_up(levels, keys)) == list(range(len(keys)))
    assert line_dedup.look_up([], keys[:3]).tolist() == [-1, -1, -1]


# --- packing ------------------------------------------------------------------------------------

def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_gapless_and_tight(documents):
    rows = packing.pack(documents, WORDS).collect()
    used = check_packing(rows, packing.CAPACITY)
    assert used <= 1.02 * -(-sum(r["length"] for r in rows) // packing.CAPACITY) + 1
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_packing_of_odd_texts(odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for doc, text in odd_rows():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected += [(doc, i // 512, i, len(ids[i:i + 512]), zlib.crc32(np.array(ids[i:i + 512], "<u4").tobytes())) for i in range(0, len(ids), 512)]
    rows = packing.pack(odd, WORDS, 512, keep_ids=True).collect()
    check_packing(rows, 512)
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=repr) == sorted(expected, key=repr)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def plain_best_fit(lengths, capacity):
    """How many sequences best fit opens when it takes the pieces one by one, the longest first."""
    rooms, opened = [], 0
    for size in sorted(lengths.elements(), reverse=True):
        at = bisect.bisect_left(rooms, size)
        room = rooms.pop(at) if at < len(rooms) else capacity
        opened += room == capacity
        bisect.insort(rooms, room - size)
    return opened


@pytest.mark.parametrize("seed", range(12))
def test_rounds_place_every_rank_once(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 9), 1]) for _ in range(rng.choice([1, 50, 3000])))
    plan = packing.best_fit_rounds(lengths, 64)
    rows = []
    for size, rank, step, number, first, n, offset in plan.moves.tolist():
        sequences = plan.sequences(np.full(n, number), np.arange(first, first + n))
        rows += [{"size": size, "rank": rank + i, "length": size, "sequence_id": int(sequences[i // step]), "offset": offset + i % step * size} for i in range(n * step)]
    used = check_packing(rows, 64)
    assert Counter((r["size"], r["rank"]) for r in rows) == Counter((s, i) for s, n in lengths.items() for i in range(n))
    assert used <= 1.02 * plain_best_fit(lengths, 64) + 1


def test_the_plan_does_not_grow_with_the_pieces():
    rng = random.Random(7)
    few = Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(20_000))
    for times in (1, 1000):
        plan = packing.best_fit_rounds({s: n * times + n % 3 for s, n in few.items()}, 4096)
        per_round = Counter(plan.moves[:, 3].tolist())
        assert max(per_round.values()) <= 2 * 4096 and len(plan.rounds) <= 60 and len(plan.moves) <= 40_000
    assert len(packing.best_fit_rounds({}, 4096).moves) == 0


# --- SimHash ------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = [w for w in (text or "").translate(LOWER).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows, linked):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and linked(rows[i][1], rows[j][1]):
                parent[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    return [min((d for d in ids[find(i)] if d is not None), default=None) for i in range(len(rows))]


def test_simhash_of_odd_texts(odd):
    prints = [(d, plain_fingerprint(t)) for d, t in odd_rows()]
    groups = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    found = simhash.simhash_groups(odd).select("doc_id", simhash.fingerprint_hex("fp").alias("fp"), "component_id")
    assert rows_of(found, "doc_id", "fp", "component_id") == sorted(((d, f"{p:016x}", g) for (d, p), g in zip(prints, groups)), key=repr)
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_golay_decodes_three_wrong_bits():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 2**23, 2000)
    index = simhash.golay_index(words)
    assert Counter(simhash.golay_index(np.arange(2**23)).tolist()).most_common(1)[0][1] == 2048
    code = words ^ simhash._ERRORS[simhash._LOW[words & 0xFFF] ^ simhash._HIGH[words >> 12]]
    for _ in range(20):
        flips = [rng.choice(23, rng.integers(0, 4), replace=False) for _ in words]
        assert (simhash.golay_index(code ^ np.array([sum(1 << int(b) for b in f) for f in flips])) == index).all()


def test_keys_meet_within_three_bits():
    rng = np.random.default_rng(6)
    one = rng.integers(0, 2**63, 3000, np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            two[i] ^= np.uint64(1 << int(bit))
    keys = []
    for prints in (one, two):
        rows, values = simhash.fuzzy_keys(prints)
        own = [set() for _ in prints]
        for r, v in zip(rows.tolist(), values.tolist()):
            own[r].add(v)
        keys.append(own)
    assert all(a & b for a, b in zip(*keys))


def test_links_are_complete_when_keys_are_cut_into_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 2**62))
    prints = {base} | {int(x) for x in rng.integers(0, 2**62, 50)}
    for _ in range(300):
        value = rng.choice(list(prints))
        for bit in rng.choice(63, 2, replace=False):
            value = int(value) ^ (1 << int(bit))
        prints.add(value)
    rows = [(p, p) for p in sorted(prints)]
    expected = plain_groups(rows, lambda a, b: (a ^ b).bit_count() <= 3)
    frame = spark.createDataFrame([(p,) for p, _ in rows], "fp bigint")
    for tile in (4096, 8):
        monkeypatch.setattr(simhash, "TILE", tile)
        roots = {r["node"]: r["root"] for r in components.components(simhash.fingerprint_links(frame)).collect()}
        assert [roots.get(p, p) for p, _ in rows] == expected


# --- token files --------------------------------------------------------------------------------

def test_token_files_round_trip(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES)
    path = fresh_path(spark, "rans-test")
    rans.write_tokens(odd, path, BYTES)
    found = sorted(rans.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(odd_rows(), key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else zlib.crc32(r[1].encode())))
    expected = [(-1 if d is None else d, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t in order]
    assert [(-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in found] == expected
    at = 0
    for r in found:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]


def test_token_files_of_an_empty_table(spark, odd):
    path = fresh_path(spark, "rans-empty")
    rans.write_tokens(odd.limit(0), path, BYTES)
    assert rans.read_tokens(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 70_000, 300_000, 800_000])
def test_segments_decode_on_their_own_and_notice_damage(n):
    ids = np.minimum(np.random.default_rng(n).geometric(0.01, n), 50_000).astype(np.int64)
    table = rans.Frequencies.unpacked(rans.Frequencies.of(ids).packed())
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(block, table) == ids).all()
    segment = rans.LANES * rans.SEGMENT_STEPS
    for s in reversed(range(len(block["states"]))):
        assert (rans.decode_segment(block, s, table) == ids[s * segment:(s + 1) * segment]).all()
    if n > 10_000:
        payload = bytearray(block["payload"])
        payload[len(payload) // 2] ^= 1
        with pytest.raises(ValueError):
            rans.decode_block({**block, "payload": bytes(payload)}, table)


# --- BPE ----------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(MANY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(MANY, public_tokenizers.PATTERN)


def test_bpe_equals_the_library(codec, library):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n\t'stlve.,!?0123éßñ漢字  \x1c\x1d\x85🙂ABC") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 2000, "\n" * 500 + "x", "ab" * 1500, "", " ", "  a", "a  ", "'ll 'LL", "x\x1cy \x1f z"]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_prefix_table_appends_and_edits(codec):
    rng = random.Random(4)
    table = bpe.PrefixTable(codec.vocabulary)
    for _ in range(40):
        table.append("".join(rng.choice("thernedabcé ") for _ in range(20)).encode())
    assert table.tokens() == bpe.PrefixTable(codec.vocabulary, table.data).tokens()
    for _ in range(25):
        begin = rng.randrange(len(table.data))
        end = min(len(table.data), begin + rng.randrange(4))
        table.edit(begin, end, "".join(rng.choice("then ") for _ in range(rng.randrange(4))).encode())
        assert table.tokens() == bpe.PrefixTable(codec.vocabulary, table.data).tokens()


def test_bpe_of_odd_texts(odd, library):
    expected = sorted(((d, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in odd_rows()), key=repr)
    found = bpe.encode_texts(odd, MANY, public_tokenizers.PATTERN).collect()
    assert sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in found), key=repr) == expected
    assert bpe.encode_texts(odd.limit(0), MANY, public_tokenizers.PATTERN).count() == 0


# --- quality ------------------------------------------------------------------------------------

def test_quality_of_odd_texts(odd):
    found = quality.quality(odd).collect()
    assert len(found) == len(odd_rows())
    assert all(r["base_failed"] and not r["kept"] for r in found if r["n_words"] < 50)
    by = {r["doc_id"]: r for r in found}
    assert by[3]["n_words"] == by[3]["word_chars"] == by[3]["n_lines"] == 0 and by[12]["word_chars"] == 9
    assert quality.quality(odd.limit(0)).count() == 0
    assert quality.ledger(odd, name="_q").columns == [*odd.columns, "_q"]


def test_repeated_words_equal_a_plain_count():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        assert quality.measure(" ".join(words).encode())[4] == len(covered)


def test_policies_and_ablations_come_from_the_bits(documents):
    rows = quality.ledger(documents).cache()
    bits = [r["f"] for r in rows.select(F.col("_ledger.failed").alias("f")).collect()]
    mask = quality.POLICIES["v1"]
    found = {r["rule"]: r for r in quality.ablations(rows, "v1").collect()}
    assert set(found) == {r.name for r in quality.RULES if mask >> r.bit & 1}
    for rule in quality.RULES:
        if mask >> rule.bit & 1:
            alone = sum(b & mask == 1 << rule.bit for b in bits)
            kept = sum(b & mask == 0 for b in bits)
            assert tuple(found[rule.name])[1:] == (sum(b >> rule.bit & 1 for b in bits), alone, kept, kept + alone)


# --- licences -----------------------------------------------------------------------------------

def plain_scan(rows):
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n") if text is not None else []
        units = ([(0, text)] if len(lines) > 1 else []) + list(enumerate(lines, 1))
        for number, unit in units:
            own, hits = set(licenses.bigrams(unit)), []
            for name, texts in licenses.TEMPLATES.items():
                for template in texts:
                    wanted = set(licenses.bigrams(template))
                    dice = 2 * len(own & wanted) / max(1, len(own) + len(wanted))
                    if own and dice >= 0.8:
                        hits.append((-dice, number, name))
            out.setdefault(doc, []).extend(h for h in hits if h[0] == min(hits)[0])
    out = {doc: hits for doc, hits in out.items() if hits}
    return {d: (min(h)[2], -min(h)[0], min(h)[1], ",".join(sorted({x[2] for x in h}))) for d, h in out.items()}


def test_licences_equal_a_plain_scan(spark, odd):
    mit = licenses.TEMPLATES["MIT"][1]
    rows = [*odd_rows(), (20, mit), (21, f"words before\n{mit}\nwords after"), (22, "Released under the MIT license"), (23, "This work is licensed under the GNU General Public License, version 2"),
            (24, mit.replace(". ", ".\n")), (25, "released under the\nMIT license"), (26, f"Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n{mit}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("doc", "best", "license", "line_no", "grams", "dice")})
    found = licenses.scan(docs).collect()
    assert len(found) == len({d for d, _ in rows})
    expected = plain_scan(rows)
    assert {r["doc_id"]: (r["license"], r["dice"], r["line_no"], r["licenses"]) for r in found if r["license"]} == expected
    assert {20, 21, 22, 23, 24, 26} <= expected.keys()
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_over_several_lines_equal_all_runs(spark):
    mit, notice = licenses.TEMPLATES["MIT"][1], "Licensed under the Apache License, Version 2.0 (the"
    apache = next(t for t in licenses.TEMPLATES["Apache-2.0"] if t.startswith(notice) and len(t) < 1000)
    prose = "\n".join(f"line {i} of the code and the words {i * 7 % 11} around it" for i in range(30))
    commented = "\n".join(f" * {line}" for line in textwrap.wrap(apache, 75))
    rows = [(1, f"{prose}\n\n{textwrap.fill(mit, 75)}\n\n{prose}"), (2, f"#!/bin/sh\n/*\n{commented}\n */\n{prose}"), (3, prose), (4, mit), (4, f"{prose}\n{mit}"),
            (5, f"a title\n\nreleased under\n\nthe MIT\nlicense\n{prose}"), (None, f"{textwrap.fill(mit, 40)}\n{prose}\n{textwrap.fill(apache, 60)}"), (6, "\n\nx\n"), (7, None),
            (8, f"{prose}\n" + textwrap.fill(mit.replace("copy", "duplicate").replace("software", "work"), 50) + f"\n{prose}"),
            (9, f"{prose}\n" + textwrap.fill("released under " * 9 + "the MIT license and nothing else is said " * 2, 20))]
    names = {"MIT": [mit, "Released under the MIT License."], "Apache-2.0": [apache]}
    expected = {}
    for doc, text in rows:
        lines, units = (text or "").split("\n"), {}
        for i, j in ((i, j) for i in range(len(lines)) for j in range(i + 1, len(lines) + 1)):
            own = set(licenses.bigrams(" ".join(lines[i:j])))
            whole, held = (i, j) == (0, len(lines)) and len(lines) > 1, lines[i].strip(" */") and lines[j - 1].strip(" */")
            rest = " ".join(lines[i + 1:j])
            begun = set(licenses.bigrams(" ".join([lines[i], *licenses.normal_words(rest)[:1]])))
            for name, texts in names.items():
                for wanted in map(set, map(licenses.bigrams, texts)):
                    dice = 2 * len(own & wanted) / (len(own) + len(wanted))
                    if dice >= 0.8 and whole:
                        units.setdefault("whole", []).append((-dice, 0, name))
                    if dice >= 0.8 and held and (j == i + 1 or begun & wanted):
                        units.setdefault((i, j == i + 1), []).append((-dice, i + 1, name))
        for hits in units.values():
            expected.setdefault(doc, []).extend(h for h in hits if h[0] == min(hits)[0])
    found = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), names).collect()
    wanted = {d: (min(h)[2], -min(h)[0], min(h)[1], ",".join(sorted({x[2] for x in h}))) for d, h in expected.items()}
    assert {r["doc_id"]: (r["license"], r["dice"], r["line_no"], r["licenses"]) for r in found if r["license"]} == wanted
    assert wanted[1] == ("MIT", 1.0, 32, "MIT") and wanted[2] == ("Apache-2.0", 1.0, 3, "Apache-2.0") and {4, 5, None} <= wanted.keys() and wanted[None][3] == "Apache-2.0,MIT"


def test_size_bounds_never_cut_a_match():
    for size in range(1, 200):
        low, high = licenses.bounds(size)
        for other in range(1, 400):
            if not low <= other <= high:
                assert 2 * min(size, other) / (size + other) < 0.8


def test_usual_notices_name_their_licence(spark):
    """The usual wordings, also some that are no template, give their licence and none of its relatives."""
    said = {"Licensed under the MIT License.": "MIT", "This project is licensed under the MIT License": "MIT", "Released under the Apache License 2.0.": "Apache-2.0",
            "Licensed under the GNU General Public License v3.0": "GPL-3.0", "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
            "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause", "// SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0", "# SPDX-License-Identifier: MIT": "MIT",
            "This project is licensed under the GNU Lesser General Public License v2.1.": "LGPL-2.1", "Released under the GNU Affero General Public License, version 3": "AGPL-3.0",
            "Code licensed under CC0 1.0": "CC0-1.0", "the project is licensed under the terms of a lease": None, "a licence to drive": None}
    rows = [(i, f"some words before\n\n{text}\n\nand some words after") for i, text in enumerate(said)]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {i: name or "" for i, name in enumerate(said.values())}


def test_licence_scan_computes_each_step_once(documents):
    """The texts are cut into words once per row for the candidates, not once per use of the words."""
    rows = licenses._templates(licenses.TEMPLATES, licenses.THRESHOLD)
    marks = [licenses._once(licenses._words(F.col("text"))).alias("words")]
    plan = documents.select("text", *marks).select("text", F.array_distinct("words").alias("w")).filter(F.size("w") > 3).select(
        F.exists("w", lambda w: w == "mit"), F.exists("w", lambda w: w == "gpl"))._jdf.queryExecution().optimizedPlan().toString()
    assert rows and plan.count("regexp_replace(") == 1 and plan.count("monotonically_increasing_id()") == 1


def test_licence_scan_stays_in_the_jvm(documents):
    plan = licenses.scan(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- embeddings ---------------------------------------------------------------------------------

def vectors():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        base = centres[i % 12] if i % 3 else rng.normal(size=16)
        rows.append((i, [float(x) for x in base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])]))
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [(430, [2 * x for x in rows[5][1]]), (5, rows[5][1])]
    rows += [(440, None), (441, []), (442, [0.0] * 16), (443, [float("nan")] * 16), (444, [float("inf")] + [0.0] * 15), (445, [None] + [1.0] * 15), (446, [1.0, 0.0]), (447, [2.0, 0.0])]
    return rows


@pytest.mark.parametrize("cell, block", [(8192, 4096), (20, 7)])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell)
    monkeypatch.setattr(embeddings, "HOME_ROWS", block)
    monkeypatch.setattr(embeddings, "GUEST_ROWS", 3 * block)
    rows = vectors()

    def good(v):
        return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        return good(a) and good(b) and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95

    groups = plain_groups(rows, linked)
    expected = sorted((i, sum(linked(v, w) for n, (_, w) in enumerate(rows) if n != m), g, g == i) for m, ((i, v), g) in enumerate(zip(rows, groups)))
    table = spark.createDataFrame([*rows, (None, rows[5][1])], "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "key", "vec", "cell", "n", "root", "mult")})
    found = rows_of(embeddings.near_vectors(table), "vec_id", "n_links", "component_id", "kept")
    assert sorted(r for r in found if r[0] is not None) == [(i, n, g, k) for i, n, g, k in expected]
    assert [r for r in found if r[0] is None] == [(None, 0, None, False)]
    assert embeddings.near_vectors(table.limit(0)).count() == 0


def test_a_worker_keeps_the_memory_of_one_operator():
    """Tokenizers and their chunks go when language identification begins in the same worker, and the other way round."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = chunks.file_encoder(path, attached=True)
    assert chunks.file_encoder(path, attached=True) is encoder
    assert list(langid._word_counts(iter([]))) == [] and common.kept("langid") == {}
    assert chunks.file_encoder(path, attached=True) is not encoder
    assert encoder.encode(["a bc, a bc"]) == chunks.file_encoder(path, attached=True).encode(["a bc, a bc"])


def test_spaced_chunks_get_twice_the_room():
    """Words with their space and case are more chunks than lower-case words, and stay as long."""
    rooms = [chunks.file_encoder(public_tokenizers.path(name), attached)._room for name, attached in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))]
    assert rooms[0] == 2 * rooms[1] == 3 * chunks.REMEMBERED
