"""The pipeline's stages: columns, what goes and what stays."""

import itertools
import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import mixing, queries
from test_operators import spans_of
from tests_llm_data import DOCS, SCHEMA


def test_stages_keep_columns_and_decide(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    told = corpus_pipeline.language(spark, docs, "")
    assert told.columns == docs.columns
    assert told.where("text is null or not exists(array('x'), x -> text rlike '\\\\p{L}')").count() == 0
    alone = corpus_pipeline.near_duplicates(spark, told.cache(), "")
    assert alone.select("text").distinct().count() == alone.count() < told.count()
    clean = corpus_pipeline.secrets(spark, alone.cache(), "")
    assert clean.count() == alone.count() and clean.where("text like '%AKIAQQQQ%'").count() == 0
    mixed = corpus_pipeline.mixture(spark, clean.cache(), "")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id", "text").count().where("count > 2").count() == 0
    coded = corpus_pipeline.tokens(spark, mixed, "")
    assert coded.where(F.size("ids") != F.col("n_tokens")).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("1 = 0"), "").count() == 0


def test_every_query_has_its_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def _fingerprint(text):
    """The contract read out plainly: 3-word shingles, repeats included, a bit set where over half of the hashes set it."""
    words = re.findall(r"[^ \t\n\v\f\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_copies_go(spark):
    """Copies, texts within two bits, chains of them, texts of few or no words; row by row against all pairs."""
    rng = random.Random(5)
    texts = [None, "", " ", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e f"]
    for _ in range(40):
        words = [f"w{rng.randrange(5_000)}" for _ in range(rng.randint(200, 900))]
        texts.append(" ".join(words))
        for edits in (0, 1, 1, 2, 4, 30):
            near = list(words)
            for _ in range(edits):
                near[rng.randrange(len(near))] = f"new{rng.randrange(10 ** 6)}"
            texts.append(" ".join(near))
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    prints = [(i, _fingerprint(t)) for i, t in docs]
    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    want = {i for i, _ in docs if find(i) == i}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    assert got == want and len(want) < 0.8 * len(docs)


def test_mixed_and_short_clean_texts_stay(spark):
    rng = random.Random(9)
    syllables = {"de": "sch ung lich ein ver keit", "en": "the ing tion ough ly wh", "fr": "eau oux que ais eur té", "sv": "ög sj ånd ska rå ngt"}
    lexicon = {k: ["".join(rng.choices(v.split(), k=rng.randint(2, 3))) for _ in range(150)] for k, v in syllables.items()}
    words = lambda lang, n: " ".join(rng.choices(lexicon[lang], k=n))
    rows = [(i, words(lang, 60), lang) for i, lang in enumerate(list(syllables) * 40)]
    mixed = [" ".join(words(x, 40) for x in langs) for size in (2, 3, 4) for langs in itertools.combinations(syllables, size)]
    short = [words(x, 2) for x in syllables]
    bad = [None, "", "12 34 !!"]
    rows += [(1_000 + i, t, None) for i, t in enumerate(mixed + short + bad)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id for r in corpus_pipeline.language(spark, frame, "").collect()}
    assert got == {i for i, t, _ in rows if t not in bad}
    # Where nothing is learned, no language can be held against a text.
    plain = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, plain, "").collect()} == got


def _components(docs):
    """Smallest id of each component of (doc_id, text) rows, by all pairs of fingerprints."""
    prints = [(i, _fingerprint(t)) for i, t in docs]
    low = {i: i for i, _ in docs}
    while True:
        pairs = [(a, b) for (a, x), (b, y) in itertools.permutations(prints, 2) if (x ^ y).bit_count() <= 2 and low[b] > low[a]]
        if not pairs:
            return low
        for a, b in pairs:
            low[b] = min(low[b], low[a])


def _redacted(text):
    at, out = 0, ""
    for start, _, _, end in spans_of(text):
        out += text[at:start] + "[secret]" if start >= at else ""
        at = max(at, end)
    return None if text is None else out + text[at:]


def test_run_row_by_row(spark, tmp_path):
    """What the language stage keeps, through plain versions of the four others: all pairs, patterns, the mix's SQL, the library's tokenizer."""
    texts = [t for t in dict.fromkeys(d[1] for d in DOCS)]
    rows = [(i, t, ["en", "de", None, "fr"][i % 4], ["a", "b", None, "c"][i * i % 4], "x", "y") for i, t in enumerate(texts + texts[3:9] + [f"{t} api_key={'k7' * 6}" for t in texts[:4]])]
    schema = "doc_id long, text string, lang string, source string, told string, row string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [tuple(r) for r in corpus_pipeline.language(spark, docs, "").collect()]
    assert 0 < len(kept) < len(rows) and set(kept) <= set(rows)
    low = _components([r[:2] for r in kept])
    alone = [r for r in kept if low[r[0]] == r[0]]
    clean = [(r[0], _redacted(r[1]), *r[2:]) for r in alone]
    assert len(alone) < len(kept) and clean != alone
    spark.createDataFrame(clean, schema).write.parquet(f"{tmp_path}/clean.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/clean.parquet/*.parquet'")
    taken = {r[0]: (r[1], r[2]) for r in con.execute(f"select doc_id, size, taken from ({mixing.SQL})").fetchall()}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for doc_id, text, _, source, *_ in clean:
        size, words = taken[doc_id]
        ids = tuple(library.encode(text or "", add_special_tokens=False).ids)
        want[doc_id, source, len(ids), ids] += words // size if size else 0
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r.n_tokens, tuple(r.ids)) for r in got) == +want and len(got) > 20


def test_columns_that_clash(spark):
    names = ["row", "told", "none", "id", "hash", "n", "digest", "spans", "fp", "root", "key", "taken", "__hash", "__told", "__blob", "__spans"]
    frame = spark.createDataFrame(DOCS, SCHEMA).withColumns({n: F.lit(n) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns
        assert out.select("doc_id", *names).distinct().count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count()
