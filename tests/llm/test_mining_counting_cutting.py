"""Hard negatives, token counts and fill-in-the-middle against plain versions; nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import fill_middle, hard_negatives, queries, token_counts
from tests_llm_data import DOCS, SCHEMA


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


# --- hard negatives --------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, row string, dim string, page int, part int, block int, kind int, wanted int"


def mined(rows, positives, negatives, low, high):
    """Plain version: every anchor row against every row, in whole numbers."""
    fine = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, label, q in fine:
        if i % 10:
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), j, other) for j, other, c in fine if j != i and len(c) == len(q)]
        for s, j, other in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out.update((i, j, r, n, -s, -t) for r, (t, n, _) in enumerate(window, 1))
    return out


def vectors(seed, n=260, dims=5):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dims))
    rows = [(i, (centre[i % 4] + 0.3 * rng.normal(size=dims)).tolist(), int(rng.choice([0, 0, 0, 1, 2, 7]))) for i in range(n)]
    # Copies of one vector, equal scores, repeated rows and ids, other lengths, and rows that take no part.
    rows += [(1_000 + i, rows[5][1], i % 2) for i in range(60)] + [rows[10], rows[10], rows[3], (20, rows[8][1], 1)]
    rows += [(2_000 + 10 * i, [0.5 * i, 0.25], i % 2) for i in range(6)] + [(3_000, [], 0), (3_010, [], 1), (3_020, [0.0] * dims, 1)]
    rows += [(None, rows[0][1], 0), (4_000, None, 0), (4_010, [None] * dims, 0), (4_020, [float("nan")] * dims, 1), (4_030, [float("inf")] + [0.0] * (dims - 1), 1), (4_040, rows[0][1], None)]
    return [(*r, "x", "y", 1, 2, 3, 4, 5) for r in rows]


@pytest.mark.parametrize("page,asking,leaf", [(8_192, 65_536, 64), (16, 7, 4)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, page, asking, leaf):
    monkeypatch.setattr(hard_negatives, "PAGE", page)
    monkeypatch.setattr(hard_negatives, "ASKING", asking)
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    rows = vectors(page)
    frame = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, 3, 4, 20, 95)
    want = mined(rows, 3, 4, 20, 95)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_of_large_numbers_and_of_nothing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (1e6 * rng.normal(size=3)).tolist(), i % 2, *[None] * 7) for i in range(40)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(frame, F.col("vec_id") % 10 == 0, 2, 3, 30, 90)
    assert Counter(map(tuple, got.collect())) == mined(rows, 2, 3, 30, 90)
    assert hard_negatives.mine(frame.where("1 = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_page_of_copies_is_split(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PAGE", 20)
    frame = spark.createDataFrame([(i, [1.0, 2.0], i % 3) for i in range(300)], "vec_id long, embedding array<double>, label int")
    index = hard_negatives.Index.of(frame.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"),
                                                 F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("dim")))
    assert max(r["count"] for r in index.rows.groupBy("page", "part").count().collect()) < 60
    got = hard_negatives.mine(frame, F.col("vec_id") == 0, 2, 2, 100, 100).collect()
    assert sorted(map(tuple, got)) == [(0, p, r, n, 327_680, 327_680) for p in (3, 6) for r, n in ((1, 1), (2, 2))]


def test_boxes_bound_scores_and_pages_hold_every_row():
    rng = np.random.default_rng(5)
    values, labels = np.floor(256 * rng.normal(size=(500, 6))), rng.integers(0, 3, 500)
    tree = hard_negatives.Tree(np.arange(500), labels, values)
    assert sorted(tree.ids) == list(range(500)) and len(tree.levels[-1].least) == 1
    query = np.floor(256 * rng.normal(size=6))
    low, high = tree.levels[0].scores(np.maximum(query, 0), np.minimum(query, 0))
    scores = tree.values @ query
    for i in range(len(low)):
        part = scores[i * hard_negatives.LEAF:(i + 1) * hard_negatives.LEAF]
        assert low[i] <= part.min() and part.max() <= high[i]
    cut, pages = hard_negatives.cut_pages(labels, values, 20)
    dealt = hard_negatives.pages_of(cut, labels, values)
    assert 15 <= pages <= 40 and np.bincount(dealt, minlength=pages).max() < 60
    assert all(len(set(labels[dealt == p])) == 1 for p in set(dealt))


# --- token counts ----------------------------------------------------------------

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
MACHINE = token_counts.Transducer(token_counts.Tokenizer.load(PATH))
PIECES = ["a", "the", " the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'l", "'ll", "r", "1", "23", "!", "?!", "é", "ß", "日", "本", "　", "\xa0", "\x85", "\x1c", "\0",
          "<|endoftext|>", "<|end", "😀", "Ω", "ing", "-----", "________", "\r\n", "é", " ", "x" * 70, " " * 40]


def counted(texts, **sizes):
    with pytest.MonkeyPatch.context() as patch:
        for name, value in sizes.items():
            patch.setattr(token_counts, name, value)
        return token_counts._counted(MACHINE, pa.array([None if t is None else t.encode() for t in texts], pa.binary())).tolist()


def by_library(texts):
    return [len(x.ids) for x in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.text(max_size=40)), max_size=6))
def test_counts_are_the_librarys(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert counted(texts) == by_library(texts)
    # Chunks of a few bytes: characters, words and runs of white space lie across cuts, and heads join over several chunks.
    assert counted(texts, CHUNK=3, FEW=0) == by_library(texts)


def test_long_texts_without_borders_and_full_tables():
    rng = random.Random(4)
    mixed = ["".join(rng.choice(PIECES) for _ in range(3_000)) for _ in range(4)]
    plain = ["a" * 9_000, "日本語" * 3_000, " " * 5_000, "'" * 3_000, "ab1" * 4_000, "x y" * 3_000, "", None]
    assert counted(mixed + plain) == by_library(mixed + plain)
    # Texts over several blocks, each from the state the last one left; the table starts anew in between.
    assert counted(mixed + plain, BLOCK=1_000, TRANSITIONS=200, CHUNK=16) == by_library(mixed + plain)


def test_broken_bytes_count_as_signs():
    broken = pa.array([b"ab\xff\xfe cd \xe6\x97", b"\x80'\xc3", b" \xf0\x9f"], pa.binary())
    assert all(n > 0 for n in token_counts._counted(MACHINE, broken).tolist())


def test_token_counts_of_every_row(spark, docs):
    told = token_counts.Tokenizer.load(PATH)
    got = docs.select("doc_id", token_counts.token_count(F.col("text"), told)).collect()
    assert Counter(map(tuple, got)) == Counter(zip([d[0] for d in DOCS], by_library([d[1] for d in DOCS])))
    assert docs.where("1 = 0").select(token_counts.token_count(F.col("text"), told)).count() == 0
    with pytest.raises(ValueError):
        token_counts.Tokenizer.load(public_tokenizers.path("word_bpe_49k.json"))


def test_token_count_query(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()
    want = Counter((d[0], len((d[1] or "").encode()), n, n > 1_024) for d, n in zip(DOCS, by_library([d[1] for d in DOCS])))
    assert Counter(map(tuple, got)) == want and {r.over_limit for r in got} == {True, False}


# --- fill in the middle ----------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def cut_plainly(doc_id, text, rate=50, suffix_first=80):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    units = UNIT.findall(text)
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    spm = h4 % 100 < suffix_first
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), output


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b\x1cé日😀<", max_size=60), st.integers(1, 9))
def test_units_and_ranks(text, piece):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fill_middle, "PIECE", piece)
        patch.setattr(fill_middle, "FAN", 2)
        widths = fill_middle.unit_widths(text.encode())
        assert widths.tolist() == [len(u) for u in UNIT.findall(text)]
        units = fill_middle.SkipList(widths)
        assert [units.points_before(r) for r in range(len(widths) + 1)] == np.concatenate([[0], np.cumsum(widths)]).tolist()


def test_lanes_carry_units_and_points():
    widths = np.arange(1, 1_001)
    units = fill_middle.SkipList(widths)
    assert len(units.lanes) == 3 and all(u.sum() == 1_000 and p.sum() == widths.sum() for u, p in units.lanes)


@pytest.mark.parametrize("rate,suffix_first", [(50, 80), (100, 50), (0, 0)])
def test_fill_middle_of_every_row(spark, docs, rate, suffix_first):
    extra = [(7_000 + i, t, *[None] * (len(DOCS[0]) - 2)) for i, t in enumerate(["a <P> b", "<S>", "x<M>", "<", "<S <P", "a" * 50, " lead and trail ", *["日本 語 é"] * 9])]
    rows = DOCS + extra
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "form": F.lit("x"), "output": F.lit("y"), "cut": F.lit("z")}).repartition(3)
    got = fill_middle.transform(frame, 42, rate, suffix_first).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    want = Counter((r[0], *cut_plainly(r[0], r[1], rate, suffix_first), r[1] or "") for r in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert fill_middle.transform(frame.where("1 = 0")).count() == 0
