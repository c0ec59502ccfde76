"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import blob_ledger, bpe, components, lang_crf, mixing, multi_index, shards, simhash_trie, suffix_dedup, tool_calls, top_k
from tests_llm_data import DOCS, SCHEMA

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("1 = 0")


def groups(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    want = groups(edges, {n for e in edges for n in e})
    assert got == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- shards --------------------------------------------------------------------


def test_best_fit_takes_the_tightest_room():
    assert shards.best_fit([(6, 1), (5, 1), (4, 2), (1, 1)], 10) == [(6, 0, 1), (5, 1, 1), (4, 0, 1), (4, 1, 1), (1, 1, 1)]
    assert shards.best_fit([(30, 1), (4, 5)], 10) == [(30, 0, 1), (4, 1, 2), (4, 2, 2), (4, 3, 1)]
    rng = random.Random(1)
    sizes = sorted(Counter(rng.randint(1, 50) for _ in range(400)).items(), reverse=True)
    rooms, want = [], []
    for size, n in sizes:
        for _ in range(n):
            fits = [i for i, r in enumerate(rooms) if r >= size]
            i = min(fits, key=lambda i: (rooms[i], i)) if fits else len(rooms)
            if not fits:
                rooms.append(64)
            rooms[i] -= size
            want.append((size, i))
    got = [(s, i) for s, i, n in shards.best_fit(sizes, 64) for _ in range(n)]
    assert len({i for _, i in got}) == len(rooms) and Counter(s for s, _ in got) == Counter(s for s, _ in want)


def test_shards_hold_whole_groups_and_gapless_slots(docs, none):
    got = shards.pack(docs, shards=4).collect()
    assert len(got) == len(DOCS)
    want = Counter((d[0], 16 + len((d[1] or "").encode()), None if d[1] is None else zlib.crc32(d[1].encode())) for d in DOCS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    of, slots = defaultdict(set), defaultdict(list)
    for r in got:
        of[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in of.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shards.pack(none, shards=4).count() == 0
    assert max(Counter(r.shard for r in shards.pack(docs, capacity=200_000).collect())) <= 3


# --- secrets -------------------------------------------------------------------

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def spans_of(text):
    found = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))" + ASSIGN.split(")", 1)[1], text or ""):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_of_every_row(spark, docs, none):
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    got = blob_ledger.find_secrets(versions, blob_ledger.new_ledger(spark)).select("path", blob_ledger.as_text(F.col("spans"))).collect()
    want = [(d[0], ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans_of(d[1]))) for d in DOCS]
    assert Counter(map(tuple, got)) == Counter(want) and any(w for _, w in want)
    empty = none.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    assert blob_ledger.find_secrets(empty, blob_ledger.new_ledger(spark)).count() == 0


def test_ledger_scans_only_what_it_has_not_seen(spark):
    ledger = blob_ledger.new_ledger(spark)
    key = "AKIA" + "Q" * 16
    first = spark.createDataFrame([("a", f"x {key}"), ("b", f"x {key}")], "path string, content string")
    assert [len(r.spans) for r in blob_ledger.find_secrets(first, ledger).collect()] == [1, 1]
    scanned = lambda: spark.read.parquet(f"{ledger}/scanned").count()
    assert scanned() == 3
    blob_ledger.find_secrets(first, ledger)
    assert scanned() == 3
    second = first.union(spark.createDataFrame([("a", "new")], "path string, content string"))
    assert blob_ledger.find_secrets(second, ledger).count() == 3 and scanned() == 6
    rules = (*blob_ledger.RULES[:2], blob_ledger.Rule("hex", 2, "[0-9a-f]+", 0, 40, "[0-9a-f]{40,}"))
    blob_ledger.find_secrets(second, ledger, rules)
    assert scanned() == 8 and spark.read.parquet(f"{ledger}/findings").count() == 1


def test_redaction_replaces_merged_spans(spark, docs):
    got = blob_ledger.redact(docs, blob_ledger.new_ledger(spark))
    assert got.columns == docs.columns

    def clean(text):
        at, out = 0, ""
        for start, _, _, end in spans_of(text):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, end)
        return None if text is None else out + text[at:]

    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((d[0], clean(d[1])) for d in DOCS)


# --- vectors -------------------------------------------------------------------


def vectors(spark, dims=16, n=300, near=120):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dims))
    x[:near] = x[0] + 0.05 * rng.normal(size=(near, dims))
    rows = [(i, [float(np.float32(v)) for v in x[i]], None if i == 5 else i % 2) for i in range(n)]
    rows += [(i + 1000, rows[2][1], 0) for i in range(50)]
    odd = [None, [], [0.0] * dims, [float("nan")] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [float("inf")] * dims, [1.0, 0.0, 2.0], [2.0, 0.0, 4.0]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[2][1], 0), rows[3], rows[3]]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")


def fine(v, zero=False):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))


def test_vector_links_match_all_pairs(spark):
    rows, frame = vectors(spark)
    good = [i for i, r in enumerate(rows) if fine(r[1]) and r[2] is not None]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    edges = [(i, j) for i in good for j in good if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98]
    links = Counter(x for e in edges for x in e)
    root = groups(edges, range(len(rows)))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]].append(r[0])
    first = {k: min((v for v in ids if v is not None), default=None) for k, ids in least.items()}
    want = Counter((r[0], links[i], first[root[i]], first[root[i]] == r[0]) for i, r in enumerate(rows))
    assert Counter(map(tuple, multi_index.near_duplicates(frame).collect())) == want
    assert multi_index.near_duplicates(frame.where("1 = 0")).count() == 0


def test_large_cells_are_dealt_in_parts(spark, monkeypatch):
    _, frame = vectors(spark)
    whole = Counter(map(tuple, multi_index.near_duplicates(frame).collect()))
    monkeypatch.setattr(multi_index, "CELL", 20)
    assert Counter(map(tuple, multi_index.near_duplicates(frame).collect())) == whole


@pytest.mark.parametrize("queries, candidates", [(8_192, 8_192), (3, 40)])
def test_top_k_matches_all_products(spark, monkeypatch, queries, candidates):
    monkeypatch.setattr(top_k, "QUERIES", queries)
    monkeypatch.setattr(top_k, "CANDIDATES", candidates)
    rows, frame = vectors(spark)
    usable = [(r[0], np.floor(256 * np.array(r[1], dtype=float)).astype(int)) for r in rows if r[0] is not None and fine(r[1], zero=True)]
    want = Counter()
    for q, x in usable:
        if q % 50 == 0:
            scores = sorted((-int(x @ y), v) for v, y in usable if v != q and len(x) == len(y))
            want.update((q, n + 1, v, -s) for n, (s, v) in enumerate(scores[:5]))
    assert Counter(map(tuple, top_k.search(frame, F.col("vec_id") % 50 == 0).collect())) == want
    assert top_k.search(frame.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


# --- tokens --------------------------------------------------------------------


def test_tokens_match_the_library(docs, none):
    vocabulary = bpe.Vocabulary.load(TOKENIZER)
    coded = docs.select("doc_id", "text", bpe.encode(F.col("text"), vocabulary).alias("ids"))
    got = coded.select("doc_id", "text", "ids", bpe.decode(F.col("ids"), vocabulary).alias("back")).collect()
    library = Tokenizer.from_file(TOKENIZER)
    assert len(got) == len(DOCS)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.back) == (ids, library.decode(ids, skip_special_tokens=False))
    both = docs.select("doc_id", "text", bpe.encode_and_decode(F.col("text"), vocabulary).alias("coded"))
    both = both.select("doc_id", "text", "coded.ids", F.col("coded.decoded").alias("back")).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, got))
    assert none.select(bpe.encode(F.col("text"), vocabulary).alias("ids")).count() == 0
    assert none.select(bpe.encode_and_decode(F.col("text"), vocabulary).alias("coded")).count() == 0


def test_backtracking_agrees_with_the_library_on_odd_texts():
    library, encoder = Tokenizer.from_file(TOKENIZER), bpe.Encoder(bpe.Vocabulary.load(TOKENIZER))
    letters = "abcdeinorst éÉßΣςİ²½ªÅ 01'\".,!<|>\n\t　\x1c\x85́中文😀"
    rng = random.Random(5)
    for n in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + "<|endoftext|>" * (n % 5 == 0)
        assert np.frombuffer(encoder.ids_of(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids, text


# --- mixture -------------------------------------------------------------------


def mixed(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", d[1] or "")) for d in rows]
    by = Counter()
    for d, n in zip(rows, size):
        by[d[3]] += n
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(by.values()) - sum(2 * by[s] for s in capped)
        level = left / (sum(weight[s] for s in order if s not in capped) or 1)
        more = {s for s in order if s not in capped and weight[s] * level > 2 * by[s]}
        if not more:
            break
        capped |= more
    target = {s: 2.0 * by[s] if s in capped else weight[s] * level for s in order}
    return size, by, target


def test_mix_meets_its_targets(docs, none):
    size, by, target = mixed(DOCS)
    got = mixing.mix(docs).collect()
    want = Counter((d[0], n, by[d[3]], round(target[d[3]], 6)) for d, n in zip(DOCS, size))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    assert all(r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source_size] += r.taken
    largest = Counter()
    for d, n in zip(DOCS, size):
        largest[by[d[3]]] = max(largest[by[d[3]]], n)
    copies = max(Counter((d[0], d[1]) for d in DOCS).values())
    for s in by:
        assert abs(taken[by[s]] - target[s]) <= largest[by[s]] * copies / 2 + 1
    assert Counter(map(tuple, mixing.mix(docs.repartition(5)).collect())) == Counter(map(tuple, got))
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert applied.select(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(none).count() == 0


# --- repeats -------------------------------------------------------------------


def stripped(rows):
    order = sorted({(d[0], d[1] or "") for d in rows if d[0] is not None})
    seen, out = set(), {}
    for doc, text in order:
        data = text.encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - 99):
            window = data[s:s + 100]
            if window in seen:
                gone[s:s + 100] = True
            seen.add(window)
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum()) if len(gone) else 0
        kept = hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()
        out[doc, text] = (doc, len(data), int(gone.sum()), runs, kept)
    return Counter(out[d[0], d[1] or ""] for d in rows if d[0] is not None)


@pytest.mark.parametrize("group", [20_000, 2])
def test_repeats_go_as_all_windows_say(docs, none, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    # Ids that differ in their text only are ordered by hashes: the plain version needs one text an id.
    one = docs.where("doc_id is not null and doc_id <> 8")
    got = Counter(map(tuple, suffix_dedup.remove_repeats(one).collect()))
    assert got == stripped([d for d in DOCS if d[0] != 8])
    assert suffix_dedup.remove_repeats(docs).count() == len(DOCS)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_two_stage_order_is_the_suffix_order():
    rng = np.random.default_rng(0)
    for letters in (2, 3, 200):
        text = np.concatenate([rng.integers(1, letters + 1, 800), np.zeros(101, dtype=int)]).astype(np.uint8)
        wanted = np.arange(600)
        order = [i for i in suffix_dedup.two_stage_order(text, wanted).tolist() if i < 600]
        data = text.tobytes()
        assert sorted(order) == list(range(600))
        keys = [data[i:i + 100] for i in order]
        assert keys == sorted(keys)


# --- language ------------------------------------------------------------------


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(2)
    evidence, move = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    ids, length = np.array([0, 1, 2, 3, 4, 5, 1]), np.array([4, 1, 2])
    got, start = lang_crf.forward_backward(evidence, ids, length, move), 0
    for n in length:
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            p = np.exp(sum(evidence[ids[start + t], path[t]] for t in range(n)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for t in range(n):
                want[t, path[t]] += p
        assert np.allclose(got[start:start + n], want / want.sum(axis=1, keepdims=True))
        start += n


def test_language_held_out_and_switched(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    model = lang_crf.train(docs)
    told = docs.select("lang", lang_crf.held_out(F.col("doc_id")).alias("h"), lang_crf.identify(F.col("text"), model).alias("t")).where("h")
    right, every = told.agg(F.count_if(F.expr("t.lang_pred = lang")), F.count(F.lit(1))).first()
    assert right / every >= 0.97
    labeller = lang_crf.Labeller(model)
    texts = {r.lang: r.text for r in docs.where("length(text) > 1500").orderBy("doc_id").collect()}
    marginals = labeller._means([lang_crf.words_of(texts["de"][:700] + " " + texts["fr"][:700])])[0]
    assert sorted(np.argsort(-marginals)[:2].tolist()) == [model.languages.index("de"), model.languages.index("fr")]


def test_language_of_odd_rows(docs, none):
    model = lang_crf.train(docs)
    got = docs.select("text", lang_crf.identify(F.col("text"), model).alias("t")).collect()
    for r in got:
        letters = any(map(str.isalpha, r.text or ""))
        assert (r.t.lang_pred != "und") == letters and 0 <= r.t.score <= 1
    nothing = lang_crf.train(none)
    assert docs.select(lang_crf.identify(F.col("text"), nothing).alias("t")).where("t.lang_pred <> 'und'").count() == 0


# --- fingerprints --------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, none, monkeypatch):
    monkeypatch.setattr(simhash_trie, "PIECE", 50)
    rows, found = simhash_trie.near_duplicates(docs)
    got = rows.join(found, "fp").select("doc_id", simhash_trie.as_hex(F.col("fp")), "component_id").collect()
    fps = [plain_fingerprint(d[1]) for d in DOCS]
    root = groups([(i, j) for i in range(len(DOCS)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2], range(len(DOCS)))
    ids = defaultdict(list)
    for i, d in enumerate(DOCS):
        ids[root[i]].append(d[0])
    first = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    assert Counter(map(tuple, got)) == Counter((d[0], f"{fps[i]:016x}", first[root[i]]) for i, d in enumerate(DOCS))
    kept = simhash_trie.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert simhash_trie.one_of_each(none).count() == 0


@pytest.mark.parametrize("group", [2_000, 3])
def test_trie_links_match_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(simhash_trie, "GROUP", group)
    rng = random.Random(4)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        base = rng.getrandbits(64)
        fps |= {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(6)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    edges = simhash_trie.link(spark.createDataFrame([(x,) for x in fps], "fp long"))
    got = groups([tuple(e) for e in edges.collect()], fps)
    want = groups([(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2], fps)
    assert got == want


# --- tool calls ----------------------------------------------------------------


def test_calls_are_linked_ordered_and_checked(spark):
    call = '{"tool_calls":[%s]}'
    one = '{"id":"%s","name":"%s","arguments":%s,"after":[%s]}'
    note = '{"text":"b\\u0061 \\"q\\"","chars":3}'
    rows = [
        (1, 0, "assistant", call % ",".join([one % ("a", "note", note, '"z"'), one % ("b", "note", '{"chars":"x","more":[1]}', '"a"')])),
        (1, 1, "tool", '{"tool_call_id":"a","content":"first"}'), (1, 2, "tool", '{"tool_call_id":"a","content":"second"}'),
        (1, 3, "assistant", call % (one % ("z", "answer", note, '"gone"'))), (1, 3, "assistant", "no json"), (1, 4, "user", None), (None, None, "assistant", None),
        (2, 0, "assistant", call % (one % ("p", "other", "[1]", '"q"'))), (2, 1, "assistant", call % (one % ("q", "note", note, '"p"'))),
        (None, 0, "assistant", call % (one % ("n", "note", note, ""))), (None, 1, "tool", '{"tool_call_id":"n","content":null}'),
    ]
    frame = spark.createDataFrame([(*r, "c", 0) for r in rows], "conv_id long, turn long, role string, text string, canonical string, slot int")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(frame, tool_calls.SCHEMAS).collect()}
    assert [got[1, c].position for c in "zab"] == [0, 1, 2]
    assert got[1, "a"].result_turn == 1 and got[1, "a"].errors == []
    assert got[1, "a"].canonical == '{"arguments":{"chars":3,"text":"ba \\"q\\""},"id":"a","name":"note","result":"first"}'
    assert got[1, "b"].errors == ["text is missing", "chars: not integer", "chars: below 1", "chars: above 199", "unknown: more"]
    assert got[1, "z"].errors == ["chars: below 200", "unknown call gone"] and got[1, "z"].result_turn is None
    assert any("circle" in got[2, c].errors for c in "pq") and "arguments are no object" in got[2, "p"].errors
    assert got[None, "n"].result_turn == 1 and got[None, "n"].canonical.endswith('"result":null}')
    assert tool_calls.link(frame.where("1 = 0"), tool_calls.SCHEMAS).count() == 0


def test_repeated_ids_surplus_results_orphans_and_calls_without_id_stay(spark):
    one = '{"tool_calls":[{"id":%s,"name":"note","arguments":{"text":"t","chars":%d},"after":[%s]}]}'
    rows = [
        (1, 0, "assistant", one % ('"x"', 1, "")), (1, 1, "tool", '{"tool_call_id":"x","content":"r1"}'),
        (1, 2, "assistant", one % ('"x"', 2, '"x"')), (1, 3, "tool", '{"tool_call_id":"x","content":"r2"}'), (1, 4, "tool", '{"tool_call_id":"x","content":"r3"}'),
        (1, 5, "assistant", one % ("null", 3, '"x"')), (1, 6, "assistant", one % ("null", 4, "")),
        (1, 7, "tool", '{"tool_call_id":"nowhere","content":"r4"}'), (1, 8, "tool", "plain"),
        (2, 0, "tool", '{"tool_call_id":"y","content":"early"}'), (2, 1, "assistant", one % ('"y"', 5, "")),
        (3, 0, "assistant", one % ('"s"', 6, "")), (3, 0, "assistant", one % ('"s"', 6, "")),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = tool_calls.link(frame, tool_calls.SCHEMAS).collect()
    told = sorted(((r.conv_id, r.turn, r.call_id, r.position, tuple(r.errors), r.result_turn) for r in got), key=str)
    assert told == sorted([
        (1, 0, "x", 0, (), 1), (1, 2, "x", 1, ("repeated id x",), 3), (1, 5, None, 2, ("call without id",), None), (1, 6, None, 3, ("call without id",), None),
        (1, None, None, None, ("surplus result of x",), 4), (1, None, None, None, ("result without call nowhere",), 7),
        (1, None, None, None, ("result without id",), 8), (2, None, None, None, ("result without call y",), 0), (2, 1, "y", 0, (), None),
        (3, 0, "s", 0, (), None), (3, 0, "s", 1, ("repeated id s",), None),
    ], key=str)
    found = {r.result_turn: r.canonical for r in got if r.result_turn is not None and r.conv_id == 1}
    assert '"result":"r2"' in found[3] and found[8] == '{"arguments":null,"id":null,"name":null,"result":"plain"}' and '"id":"x"' in found[4]
