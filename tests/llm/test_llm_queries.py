"""The registered queries next to SQL or brute force over whole small tables, and the pipeline."""

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallymill.llm import quality, simhash
from tallymill.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect
from tests.llm.test_operators import CLASHING, check_packing, odd_rows, plain_fingerprint, plain_groups, plain_line_dedup

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, DIRECTORY), duck, ORACLES[name]) is None


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_main_text(spark):
    rows = QUERIES["op1_main_text"](spark, DIRECTORY).collect()
    assert len(rows) == spark.read.parquet(f"{DIRECTORY}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 and "<" not in r["text"].replace("<<", "") or r["text"].count("<") for r in rows)


class Article(HTMLParser):
    """The blocks of a page's article as the standard parser's events give them."""

    BLOCKS = {"article", "h1", "h2", "h3", "p", "ul", "ol", "li", "div", "blockquote", "pre", "table", "tr", "td", "th", "section", "figure"}
    APART = {"aside", "script", "style", "form", "nav", "footer", "header"}

    def __init__(self, html):
        super().__init__()
        self.inside, self.apart, self.blocks, self.words = 0, 0, [], ""
        self.feed(html)
        self.flush()

    def flush(self):
        if joined := " ".join(self.words.split()):
            self.blocks.append(joined)
        self.words = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS | self.APART:
            self.flush()
        self.inside += tag == "article"
        self.apart += tag in self.APART
        self.words += " " * (tag == "br")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS | self.APART:
            self.flush()
        self.inside -= tag == "article"
        self.apart -= tag in self.APART

    def handle_data(self, data):
        self.words += data if self.inside and not self.apart else ""


def test_main_text_equals_the_article_by_another_parser(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIRECTORY}/pages.parquet").collect()}
    found = {r["page_id"]: r["text"] for r in QUERIES["op1_main_text"](spark, DIRECTORY).collect()}
    assert found == {i: "\n".join(Article(html).blocks) for i, html in pages.items()}


def test_simhash(spark, texts):
    prints = [(d, plain_fingerprint(t)) for d, t in texts]
    groups = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    found = {tuple(r) for r in QUERIES["op5_simhash"](spark, DIRECTORY).select("doc_id", "fingerprint", "component_id").collect()}
    assert found == {(d, f"{p:016x}", g) for (d, p), g in zip(prints, groups)}


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, expected = 0, set()
    for doc, text in sorted(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        expected.add((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert {tuple(r) for r in QUERIES["op6_rans_tokens"](spark, DIRECTORY).collect()} == expected


def test_byte_bpe(spark, texts):
    import base64

    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = set()
    for doc, text in texts:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        expected.add((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op7_byte_bpe"](spark, DIRECTORY).collect()} == expected


def test_packing(spark, texts):
    rows = QUERIES["op4_best_fit_packing"](spark, DIRECTORY).collect()
    check_packing(rows, 4096)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start:start + 4096]
            expected.add((doc, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows} == expected and len(rows) == len(expected)


# --- pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "line_dedup", "simhash_dedup", "best_fit_packing"]
    known = stages["language_id"](spark, docs, DIRECTORY)
    assert known.columns == docs.columns and known.count() >= 0.95 * docs.count()
    good = stages["quality_rules"](spark, known, DIRECTORY)
    wanted = {r["doc_id"] for r in quality.quality(known).filter("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == wanted
    lines = stages["line_dedup"](spark, good, DIRECTORY)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert sorted((r["doc_id"], r["text"]) for r in lines.collect()) == sorted(r[:2] for r in plain_line_dedup(rows))
    single = stages["simhash_dedup"](spark, lines, DIRECTORY)
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in lines.collect()]
    groups = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= simhash.MAX_BITS)
    kept = {d for (d, _), g in zip(prints, groups) if d == g}
    assert {r["doc_id"] for r in single.collect()} == kept and single.columns == docs.columns
    packed = corpus_pipeline.run(spark, DIRECTORY).collect()
    assert {r["doc_id"] for r in packed} == kept
    check_packing(packed, 4096)


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(d, t, None, None, None) for d, t in odd_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(1) for c in CLASHING})
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, DIRECTORY).columns == docs.columns
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, DIRECTORY).count() >= 0
