"""Every operator against its plain form, over a whole table and over awkward rows."""

import itertools
import random
import tracemalloc
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import exact_dedup, lm, packing, pii, quality_classifier, quality_rules, sentencepieces, similar, simhash, suffix_dedup, token_output

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, row long, part int, label int, keep_id long"


def awkward():
    r = random.Random(5)
    vocabulary = ["the", "of", "Über", "naïve", "日本語", "x" * 30, "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+49 (30) 1234-567", "|", "!!", "😀", "it's", "▁", "<|endoftext|>", "é"]
    line = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", "  ", "\t", " ", "\r\n", " \n"]) for _ in range(n))
    passage = line(40)
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, ""), (5, passage), (6, passage), (7, line(9) + passage + line(9)), (8, passage.replace(" ", "\n")),
        (None, passage), (None, None), (9, line(6000)), (10, "a" * 70_000), (11, "a" * 200), (12, ("the of " * 400)), (5, passage), (13, "x\x01y a@b.co \x01"), (14, "one"), (15, "one two"),
        (16, "ONE TWO three"), (17, "call 555-123-4567 or me [at] home [dot] org today"), (18, "\x00\x00" * 100), (19, line(30)), (-4, passage[5:]),
        (20, "9" * 30 + " 4111-1111-1111-1111 1.2.3.4.5.6.7.8 999.1.1.1 +1 2 +12345678901234567 a@b.c@d.e_x@y.zz a@b.co_m@x.y"),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, *[None] * 8) for d, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module", params=["table", "awkward", "empty"])
def data(request, spark, sf_dir):
    if request.param == "table":
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return docs, [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = awkward() if request.param == "awkward" else []
    return frame(spark, rows), rows


def same(df, expected, columns=None):
    df = df.select(columns) if columns else df
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(expected, key=repr)


def test_suffix_dedup(data):
    docs, rows = data
    same(suffix_dedup.remove_repeats(docs), brute.op1(rows))


@pytest.mark.parametrize("whole", [0, 2, 8])
def test_suffix_dedup_over_many_buckets_and_parted_words(spark, monkeypatch, whole):
    monkeypatch.setattr(suffix_dedup, "WHOLE", whole)
    r = random.Random(3)
    words = ["".join(r.choices("abcde", k=r.randint(1, 9))) for _ in range(60)]
    text = lambda n: " ".join(r.choices(words, k=n))
    hot = text(20)
    rows = [(i, text(r.randint(0, 40)) + (hot if i % 2 else "") + text(r.randint(0, 30))) for i in range(150)]
    rows += [(150 + i, hot) for i in range(100)]
    same(suffix_dedup.remove_repeats(frame(spark, rows), buckets=97), brute.op1(rows))


def test_suffix_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, "q" * 10 + "abcdefghij" * 6), (2, "abcdefghij" * 6), (2, "zz" + "klmnopqrst" * 6 + "abcdefghij" * 6), (2, "")]
    same(suffix_dedup.remove_repeats(frame(spark, rows)), brute.op1(rows))


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (50_000, 4)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(words, small=64)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all()


def test_exact_dedup(data):
    docs, rows = data
    same(exact_dedup.exact_groups(docs), brute.op2(rows))


def test_exact_dedup_spills_by_subtree(data):
    docs, rows = data
    same(exact_dedup.exact_groups(docs, trie_bytes=2000), brute.op2(rows))


def test_patricia_trie():
    r = random.Random(1)
    texts = [bytes(r.choices(b"ab", k=r.randint(0, 12))) for _ in range(3000)]
    for limit in (1 << 30, 900):
        trie = exact_dedup.PatriciaTrie(limit)
        for i, t in enumerate(texts):
            trie.insert(t, i, 1)
        assert sorted(trie.groups()) == sorted((t, texts.index(t), texts.count(t)) for t in set(texts))


def test_exact_dedup_keeps_all_columns(spark):
    kept = exact_dedup.exact_dedup(frame(spark, awkward()))
    assert kept.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    expected = [(d, t) for (d, t), g in zip(awkward(), [next(x for x in brute.op2(awkward()) if x[0] == d and x[4] == brute.op2([(d, t)])[0][4]) for d, t in awkward()]) if g[3]]
    same(kept, expected, ["doc_id", "text"])


def test_token_output(data):
    docs, rows = data
    t = Tokenizer.from_file(BYTE)
    t.encode_special_tokens = True
    same(token_output.encode_and_index(docs, BYTE), brute.op3(rows, t))


def test_token_files_allow_selective_reads(spark, tmp_path):
    """Row groups and pages of set sizes with page indexes, dictionary and delta encodings, columns of their own."""
    import pyarrow.parquet as pq

    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"{r.choice(['the', 'of', 'x'])}{r.randint(0, 40000)}" for _ in range(120))) for i in range(6000)], "doc_id long, text string")
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, BYTE)
    tokens = token_output.read_tokens(spark, path)
    assert tokens.count() == 6000 and [x["doc_id"] for x in tokens.filter("doc_id between 100 and 102").orderBy("doc_id").collect()] == [100, 101, 102]
    assert "ids" not in tokens.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    encodings = set()
    for file in sorted((tmp_path / "tokens").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            assert meta.row_group(g).total_byte_size <= 40 << 20
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                encodings |= set(column.encodings)
                assert column.has_column_index and column.has_offset_index
    assert any("DICTIONARY" in e for e in encodings) and any("DELTA" in e for e in encodings)


def test_personal_data(data):
    docs, rows = data
    got = pii.personal_data(docs)
    same(got, [x[:6] for x in brute.op4(rows)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])
    base = {(x[0], x[5]): set(filter(None, x[6].split(","))) for x in brute.op4(rows)}
    for r in got.collect():
        assert base[r["doc_id"], r["base_sha256"]] <= set(r["spans"].split(","))


def test_personal_data_adds_further_spellings(spark):
    rows = [(i, f"write to u{i}.x@mail{i}.example.com or 10.0.0.{i} or 99.300.1.{i}") for i in range(50)]
    rows += [(100, "phone 212-555-0187 now"), (101, "mail me at jo.doe [at] example [dot] com soon"), (102, "in 1999 we had 12 of 345")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert (got[100], got[101], got[102]) == ("phone:6:18", "email:11:40", "")


def test_personal_data_context_decides_on_further_spellings(spark):
    rows = [(i, f"phone {212 + i}-555-{1000 + i} now") for i in range(80)] + [(100 + i, f"sizes of {12 + 13 * i:03d} 512 {1024 + i} bytes") for i in range(60)]
    rows += [(200, "page sizes of 256 512 1024 bytes"), (201, "call 256 512 1024 now"), (202, "call 056 512 1024 now")]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert all(got[i] == "phone:6:18" for i in range(80)) and not any(got[100 + i] for i in range(60))
    assert (got[200], got[201], got[202]) == ("", "phone:5:17", "")


def test_redaction(spark):
    rows = [(1, "a@b.co and 1.2.3.4 end"), (2, None), (3, "clean"), (4, "+49 30 1234567")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert got == {1: "<email> and <ip> end", 2: None, 3: "clean", 4: "<phone>"}


def test_redaction_passes_columns_of_any_name_through(spark):
    rows = [(1, "a@b.co", "s", ["x"], 0.5, "p"), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string, spans array<string>, chosen double, row string")
    got = pii.redact(docs)
    assert got.schema == docs.schema
    assert sorted(tuple(r) for r in got.collect()) == [(1, "<email>", "s", ["x"], 0.5, "p"), rows[1]]


def test_personal_data_of_a_text_with_thousands_of_addresses(spark):
    text = " ".join(f"u{i}@example.com, call 212-555-{i % 9000 + 1000:04d}" for i in range(3000))
    rows = [(1, text), (2, "u@example.com"), (3, text[:9000])]
    got = pii.personal_data(frame(spark, rows))
    same(got, [x[:6] for x in brute.op4(rows)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"])


def test_boosting_learns_from_format_and_context_alone():
    cells = [({n: 0 for n, _ in pii.FEATURES} | {"kind": k, "alone": a, "cue": c}, 10 * c + a, 10 * (1 - c)) for k, a, c in itertools.product(range(4), range(2), range(2))]
    model = pii.boost(cells, pii.SPLITS)
    assert all("valid" not in (t.root[0], *(n for n, _ in t.sides)) for t in model.trees)
    assert min(model.score(x) for x, _, _ in cells if x["cue"]) > max(model.score(x) for x, _, _ in cells if not x["cue"])
    assert pii.boost([]) is None
    model.calibrate(cells, [], 0.98)
    assert all(min(model.score(x) for x, _, _ in cells if x["cue"]) >= model.thresholds[k] > max(model.score(x) for x, _, _ in cells if not x["cue"]) for k in range(4))


def test_quality_rules(data):
    docs, rows = data
    got = quality_rules.apply_policy(quality_rules.ledger(docs)).withColumn("base_failed", (quality_rules.F.col("failed").bitwiseAND(quality_rules.POLICIES["base"])) != 0)
    same(got, brute.op5(rows), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    assert got.filter("base_failed and kept").isEmpty()


def test_quality_rules_ablation(data):
    docs, _ = data
    rows = quality_rules.ledger(docs)
    failed = [r["failed"] for r in rows.collect()]
    for r in quality_rules.ablation(rows).collect():
        bit = quality_rules.BIT[r["rule"]]
        assert (r["failed"], r["failed_alone"]) == (sum(bool(f & bit) for f in failed), sum(f == bit for f in failed))


def test_simhash(data):
    docs, rows = data
    same(simhash.near_groups(docs), brute.op6(rows))


def test_simhash_links_of_crowded_fingerprints(spark):
    r = random.Random(2)
    centre, far = r.getrandbits(64), [r.getrandbits(64) for _ in range(50)]
    prints = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(600)} | set(far))
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    from tidemark.llm.components import components

    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long, node long"))
    got = {x["node"]: x["component"] for x in components(links).collect()}
    parent = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2 and parent[i] != parent[j]:
            a, b = min(parent[i], parent[j]), max(parent[i], parent[j])
            parent = [a if x == b else x for x in parent]
    assert [got.get(i, i) for i in range(len(prints))] == parent


def test_pigeonring_never_misses():
    pairs = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in itertools.combinations(range(64), 2))]
    assert simhash.has_chain(np.array(pairs, np.uint64)).all()
    rng = np.random.default_rng(0)
    assert simhash.has_chain(rng.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.01


def test_components_of_a_chain(spark):
    from tidemark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("held", [2, 2_000_000])
def test_components_equal_union_find(spark, monkeypatch, held):
    """A path in random order, a hub, a tree and loose pairs, contracted little and much."""
    from tidemark.llm import components

    monkeypatch.setattr(components, "HELD_LINKS", held)
    r = random.Random(6)
    names = r.sample(range(-5000, 5000), 900)
    edges = [(names[i], names[i + 1]) for i in range(200)] + [(names[300], names[i]) for i in range(301, 500)] + [(names[i], names[600 + (i - 601) // 2]) for i in range(601, 760)] + [(names[800 + 2 * i], names[801 + 2 * i]) for i in range(40)]
    parent = {n: n for e in edges for n in e}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = components.components(spark.createDataFrame(r.sample(edges, len(edges)), "a long, b long").repartition(7))
    assert dict(map(tuple, got.collect())) == {n: find(n) for n in parent}


def test_packing(data):
    docs, rows = data
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    expected = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        expected += [(d, i // 2048, i, len(ids[i : i + 2048]), brute.crc_ids(ids[i : i + 2048])) for i in range(0, len(ids), 2048)]
    got = packing.pack(docs, WORD).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(x[3] for x in expected)
    assert len(bins) <= -(-total // 2048) * 1.01 + 1


def test_packing_plan_places_all_and_nears_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 2048)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    chosen = packing.plan(histogram)
    placed = {}
    for c, n in chosen:
        assert sum(k * a for k, a in c) <= 2048
        for k, a in c:
            placed[k] = placed.get(k, 0) + a * n
    assert placed == histogram
    assert sum(n for _, n in chosen) <= -(-int(lengths.sum()) // 2048) * 1.002 + 1
    assert packing.plan({}) == []
    assert sum(n for _, n in packing.plan({1500: 10, 600: 7})) == 13


def test_packing_takes_most_sequences_from_the_program():
    rng = np.random.default_rng(9)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 30_000).astype(int) + 1, 2048)
    by_program, by_fit = packing.solved(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))))
    program = sum(n for c, n in by_program if c != ((2048, 1),))
    assert program > 0.6 * (program + sum(n for _, n in by_fit))
    assert all(sum(k * a for k, a in c) == 2048 for c, _ in by_program)


def test_lm_base(data):
    docs, rows = data
    got = lm.score_documents(docs, per_root=1.0, frequent=100)
    key = lambda r: repr(tuple(r)[:5])
    for a, b in zip(sorted(got.collect(), key=key), sorted(brute.op8(rows), key=key), strict=True):
        assert tuple(a)[:5] == b[:5]
        assert a["base_score"] == pytest.approx(b[5], abs=1e-6)
        assert a["score"] < 0


def test_lm_beats_the_base_on_held_out_texts(spark, sf_dir):
    got = lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def words_model(counts: dict, n_units: int, buckets: int):
    """A model over these counts, and its words' codes and shares within their units by the definition."""
    known = sorted(counts, key=lambda w: (-counts[w], w))
    rare = known[n_units:]
    sizes = np.ones(buckets)
    for w in rare:
        sizes[lm.bucket(w, buckets)] += counts[w] + 1
    units = lm.arrange([counts[w] for w in known[:n_units]], sizes, [lm.bucket(w, buckets) for w in rare])
    within = {w: (counts[w] + 1) / sizes[lm.bucket(w, buckets)] if w in rare else 1.0 for w in known}
    return lm.LogBilinear(units), lm.Codes(known, buckets), within, sizes


def test_lm_tokens_counts_and_buckets_are_those_of_single_words():
    """Read as arrays; before, word by word in Python, which the CPU budget didn't allow."""
    texts = ["", " ", "a", "  A\tb\x0bC\x0c\r\n", "É Éa ÀB", "x\x1cy z\u0085w\xa0q", "İI the", "THE end "]
    split = [t.translate({i: i + 32 for i in range(65, 91)}).encode().split() + [lm.END] for t in texts]
    for column in (pa.array(texts), pa.array(["skipped one", *texts]).slice(1), pa.array(texts, pa.large_string())):
        tokens, sizes = lm.words(column)
        assert tokens.to_pylist() == [w for ws in split for w in ws] and sizes.tolist() == [len(ws) for ws in split]
    counts = {}
    for batch in lm._count([pa.record_batch([pa.array(texts)], names=["text"])] * 3):
        for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
            counts[w] = counts.get(w, 0) + c
    assert counts == {w: 3 * c for w, c in brute.Counter(w for ws in split for w in ws).items()}
    found = pa.array([b"", b"a", b"zz", b"abc", b"\x00\xff\x80", *(f"w{i}".encode() for i in range(200))], pa.binary())
    for part in (found, found.slice(3, 90), found.slice(0, 0)):
        assert lm.buckets_of(part, 37).tolist() == [lm.bucket(w, 37) for w in part.to_pylist()]
    code = lm.Codes([b"the", b"a"], 37)
    at, other, rare = code.of(lm.words(pa.array(texts))[0])
    flat = [w for ws in split for w in ws]
    assert at.tolist() == [code[w] for w in flat] and rare.to_pylist() == [flat[i] for i in other] and lm.END in rare.to_pylist()


def test_lm_step_equals_its_plain_form():
    """One step of a batch, token by token."""
    counts = {f"w{i}".encode(): 1 + 900 // (i + 1) ** 2 for i in range(60)}
    model, *_ = words_model(counts, 50, 3)
    assert (np.diff(model.units.first) == 1).any()
    k, first, size = model.k, model.units.first, lm.SIZE
    before, earlier, unit = np.random.default_rng(5).integers(0, k, (3, 70))
    rng, p = np.random.default_rng(9), model.p.astype(float)
    classes = np.searchsorted(np.cumsum(model.class_share), rng.random(lm.NOISE) * (1 - 1e-9)).clip(0, model.c - 1)
    drawn = np.searchsorted(model.running, model.running_before[:, None] + rng.random((model.c, lm.NOISE)) * model.class_share[:, None]).clip(first[:-1, None], first[1:, None] - 1)
    grad, one, two = np.zeros_like(p), p[k + model.c : k + model.c + size, :size], p[k + model.c + size :, :size]
    for b, e, u in zip(before, earlier, unit):
        r, c, back = np.append(one @ p[b, :size] + two @ p[e, :size], 1.0), model.class_of[u], np.zeros(size + 1)
        pairs = [(k + x, model.log_class[x], 0) for x in classes] + [(k + c, model.log_class[c], 1)]
        if first[c + 1] - first[c] > 1:
            pairs += [(x, model.log_unit[x], 0) for x in drawn[c]] + [(u, model.log_unit[u], 1)]
        for row, noise, label in pairs:
            error = 1 / (1 + np.exp(noise - r @ p[row])) - label
            grad[row] += error * r
            back += error * p[row]
        for start, at, context in ((k + model.c, b, one), (k + model.c + size, e, two)):
            grad[start : start + size, :size] += np.outer(back[:size], p[at, :size]) / 16
            grad[at, :size] += back[:size] @ context
    met = np.zeros(len(p))
    model.step(np.ones_like(model.p), met, np.random.default_rng(9), before, earlier, unit, 0.2)
    assert np.abs(model.p - (p - 0.2 * grad / np.sqrt(1 + grad**2))).max() < 1e-4
    assert met[:k].sum() == 3 * 70


def test_lm_is_normalised_over_the_vocabulary():
    r = random.Random(2)
    counts = {f"w{i}{r.choice('abcdef')}".encode(): 1 + 3000 // (i + 1) for i in range(400)} | {lm.END: 50}
    model, code, within, sizes = words_model(counts, 60, 9)
    rng = np.random.default_rng(0)
    tokens = rng.integers(0, model.k, 3000)
    model.train(tokens[:-2], tokens[1:-1], tokens[2:], seed=1)
    all_units = np.arange(model.k)
    for before, earlier in rng.integers(0, model.k, (5, 2)):
        unit = np.exp(model.log_probabilities(np.full(model.k, before), np.full(model.k, earlier), all_units))
        assert unit.sum() == pytest.approx(1, abs=1e-5)
        p = sum(unit[model.units.unit_of[code[w]]] * within[w] for w in counts)
        unseen = sum(unit[model.units.unit_of[code.n + b]] / sizes[b] for b in range(9))
        assert p + unseen == pytest.approx(1, abs=1e-5)


def test_lm_learns_which_word_follows():
    counts = {f"w{i:02d}".encode(): 100 for i in range(30)}
    model, *_ = words_model(counts, 30, 1)
    tokens = np.tile(np.arange(30), 400)
    before, earlier, unit = tokens[1:-1], tokens[:-2], tokens[2:]
    start = model.log_probabilities(before, earlier, unit).mean()
    for turn in range(3):
        model.train(before, earlier, unit, seed=turn)
    assert model.log_probabilities(before, earlier, unit).mean() > 0.2 * start


def test_lm_score_equals_the_sum_over_tokens(spark):
    """Every document's score, put together from the model's parts, with words that documents meet in a join."""
    r = random.Random(4)
    vocabulary = [f"x{i}{r.choice('abc')}" for i in range(300)]
    rows = [(i, " ".join(r.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=r.randint(0, 40)))) for i in range(120)] + [(500, "never seen words"), (501, None)]
    docs = frame(spark, rows)
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = brute.Counter(w.encode() for d, t in rows if not out(d) for w in brute.WORD.findall(t or "")) + brute.Counter({lm.END: sum(not out(d) for d, _ in rows)})
    counts = spark.createDataFrame(list(c.items()), "word binary, c long")
    v = lm.vocabulary(counts, len(c), 2.0, 40)
    model = lm.fit(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)), v.known, v.buckets, v.units())
    code, expected = lm.Codes(v.known, v.buckets), {}
    for d, t in rows:
        tokens = [w.encode() for w in brute.WORD.findall(t or "")] + [lm.END]
        unit = model.units.unit_of[[code[w] for w in tokens]]
        end = model.units.unit_of[code[lm.END]]
        context = np.concatenate([[end, end], unit])
        total = model.log_probabilities(context[1:-1], context[:-2], unit).sum() / np.log(10)
        expected[d] = total + sum(np.log10((c[w] + 1) / v.bucket_sizes[lm.bucket(w, v.buckets)]) for w in tokens if w not in v.known[: v.n_units])
    got = {x["doc_id"]: x["score"] for x in lm.score_documents(docs, per_root=2.0, frequent=40).collect()}
    assert got == {d: pytest.approx(x, abs=0.02) for d, x in expected.items()}


def test_quality_classifier(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.score_documents(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)


def test_quality_classifier_on_awkward_rows(data, spark):
    docs, rows = data
    for labels in ([], [(5, 1), (9, None), (10, 0), (None, 1)]):
        got = quality_classifier.score_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(d) for d, _ in rows)
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def sf001(spark, sf_dir):
    return [spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels")]


def test_quality_scores_equal_plain_quadratic_discriminants(spark, sf_dir):
    docs, labels = sf001(spark, sf_dir)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    x = {d: np.array(quality_classifier.features(t)) for d, t in texts.items()}
    taught = [(r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in x]
    own = [np.array([x[d] for d, q in taught if q == c]) for c in (0, 1)]
    centred = [a - a.mean(0) for a in own]
    pooled = sum(a.T @ a for a in centred) / (len(taught) - 2)
    density = []
    for a, b in zip(own, centred):
        cov = 0.98 * (0.8 * b.T @ b / (len(a) - 1) + 0.2 * pooled) + 0.02 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        inverse, half = np.linalg.inv(cov), np.linalg.slogdet(cov)[1] / 2
        density.append({d: -0.5 * (v - a.mean(0)) @ inverse @ (v - a.mean(0)) - half + np.log((len(a) + 1) / (len(taught) + 2)) for d, v in x.items()})
    for r in quality_classifier.score_documents(docs, labels).collect():
        d = np.clip(density[0][r["doc_id"]] - density[1][r["doc_id"]], -60, 60)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(d)), abs=1e-6)


def test_quality_stage_decides_row_by_row(spark, sf_dir):
    docs, labels = sf001(spark, sf_dir)
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.score_documents(docs, labels).collect()}
    lost = docs.withColumn("true_id", F.col("doc_id")).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).when(F.col("doc_id") % 3 == 1, 0)).withColumn("_rejected", F.lit(1))
    taught = {r["doc_id"] for r in labels.filter("doc_id % 3 = 0 and doc_id > 0").collect()}
    model_labels = labels.filter(F.col("doc_id").isin(sorted(taught)))
    kept = quality_classifier.drop_low_quality(lost, model_labels)
    assert kept.columns == lost.columns
    expected = {r["doc_id"]: r["predicted"] for r in quality_classifier.score_documents(docs, model_labels).collect()}
    assert sorted(r["true_id"] for r in kept.collect()) == sorted(d for d, p in expected.items() if p)
    assert scores and any(d % 3 == 2 and p for d, p in expected.items())


def test_taught_labels_are_bounded(spark):
    labels = spark.range(20_000).selectExpr("id as doc_id", "id % 2 as quality")
    assert 300 < quality_classifier.taught_labels(labels, 400).count() < 500
    assert quality_classifier.taught_labels(labels, 20_000).filter(quality_classifier.held_out(F.col("doc_id"))).isEmpty()


def test_sentencepiece(data):
    docs, rows = data
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    expected = []
    for d, t in rows:
        ids = library.encode(t or "")
        back = (t or "").replace("▁", " ")
        expected.append((d, len(ids), brute.crc_ids(ids), brute.sha256(back.encode()).hexdigest(), True))
    same(sentencepieces.digests(docs, PIECE), expected)
    encoded = sentencepieces.encode(docs, PIECE)
    same(sentencepieces.decode(encoded, PIECE), [(d, (t or "").replace("▁", " ")) for d, t in rows])


def test_sentencepiece_on_random_strings():
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepieces.Encoder(sentencepieces.load(PIECE))
    r = random.Random(8)
    for _ in range(60):
        texts = ["".join(r.choices("aaeinrst  \n\t▁éß日x.,-1", k=r.randint(0, 40))) for _ in range(30)]
        ids, counts = encoder.encode(texts)
        assert np.split(ids, np.cumsum(counts)[:-1])[0].tolist() == library.encode(texts[0])
        assert ids.tolist() == [i for t in texts for i in library.encode(t)]


def test_sentencepiece_memory_grows_with_the_word_not_its_square():
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepieces.Encoder(sentencepieces.load(PIECE))
    word = "".join(random.Random(9).choices("ABCDEFGHabcdefgh0123456789+/", k=6000))
    encoder.encode([word[:100]])
    tracemalloc.start()
    try:
        ids, _ = encoder.encode([word])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids.tolist() == library.encode(word)
    assert peak < 20 << 20


def test_sentencepiece_of_a_very_long_word():
    library, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepieces.Encoder(sentencepieces.load(PIECE))
    word = "".join(random.Random(10).choices("ABCDEFGHabcdefgh0123456789+/日本語", k=150_000))
    assert encoder.encode([word])[0].tolist() == library.encode(word)


def test_unigram_model_takes_the_best_path():
    model = sentencepieces.load(PIECE)
    kind, model.kind = model.kind, sentencepieces.UNIGRAM
    try:
        for word in ("▁theing", "▁sttion", "▁abc"):
            def best(w):
                if not w:
                    return 0.0
                return max(model.scores.get(w[:n], model.unknown_score if n == 1 else -1e30) + best(w[n:]) for n in range(1, len(w) + 1))

            got = model.encode_sorted([word])[0]
            texts = ["▁" + model.text[i].decode()[1:] if model.text[i].startswith(b" ") else model.text[i].decode() for i in got]
            assert "".join(texts) == word
            assert sum(model.scores.get(t, model.unknown_score) for t in texts) == pytest.approx(best(word))
    finally:
        model.kind = kind


def test_similar_texts_share_a_group(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, truth = [], {}
    for base in range(0, 4000, 100):
        words = [vocabulary[i] for i in rng.integers(0, 3000, 600)]
        for copy in range(40 if base == 0 else 2):
            changed = list(words)
            for at in rng.integers(0, 600, 2) if copy else []:
                changed[at] = "changed"
            rows.append((base + copy, " ".join(changed)))
            truth[base + copy] = base
    rows += [(9000, None), (9001, ""), (9002, "one two three"), (9003, "one two four")]
    truth |= {9000: 9000, 9001: 9000, 9002: 9002, 9003: 9003}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1))
    found = dict(map(tuple, similar.similar_groups(docs).collect()))
    assert found == truth
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(truth.values()))
    assert similar.similar_groups(docs.limit(0)).count() == 0


def test_similar_groups_equal_brute_force(spark):
    """Edits around the wanted similarity: links are those of the exact sets, and texts below it stay apart."""
    rng = np.random.default_rng(11)
    rows = []
    for base in range(0, 600, 10):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        rows.append((base, " ".join(words)))
        for copy, cut in enumerate((15, 25, 45, 70), 1):
            changed = list(words)
            changed[20 : 20 + cut] = [f"v{i}" for i in rng.integers(0, 5000, cut)]
            rows.append((base + copy, " ".join(changed)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    found = dict(map(tuple, similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    truth = {}
    for base in range(0, 600, 10):
        group = {i: i for i in range(base, base + 5)}
        for i in group:
            for j in range(base, i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    low, high = sorted((group[i], group[j]))
                    group = {k: low if v == high else v for k, v in group.items()}
        truth |= group
    wrong = [i for i in truth if found[i] != truth[i]]
    assert not [i for i in wrong if found[i] < truth[i]]
    assert len(wrong) <= 0.03 * len(truth)


@pytest.mark.parametrize("size,recall", [(4, 1), (8, 1), (12, 1), (16, 0.95), (48, 0.95)])
def test_short_texts_of_the_wanted_similarity_are_found(spark, size, recall):
    """Pairs with a Jaccard similarity of exactly 0.8, and others just below it, among texts that share a frequent shingle."""
    rng = np.random.default_rng(size)
    new = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    rows = [(10_000 + i, " ".join(["one", "of", "the", "same", "five", *new(1)])) for i in range(300)]
    for base in range(0, 600, 3):
        words, more = new(size + 4), size // 4
        rows += [(base, " ".join(words)), (base + 1, " ".join([*words, *new(more)] if base % 2 else [*new(more), *words])), (base + 2, " ".join([*new(more + 1), *words[:-1], *new(1)]))]
    found = dict(map(tuple, similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert np.mean([found[b + 1] == b for b in range(0, 600, 3)]) >= recall
    assert all(found[b + 2] == b + 2 for b in range(0, 600, 3)) and all(found[i] == i for i, _ in rows[:300])


def templated(kinds: str, seed: int = 5) -> tuple[list, dict]:
    """Texts of one template, each with a passage of its own place replaced, and their sets: two of kind a have a similarity of 0.806, of kind b 0.784, a and b 0.795."""
    rng = np.random.default_rng(seed)
    words, rows, at = [f"w{i}" for i in rng.integers(0, 5000, 600)], [], 4
    for i, kind in enumerate(kinds):
        cut = 28 if kind == "a" else 32
        rows.append((i, " ".join(words[:at] + [f"v{x}" for x in rng.integers(0, 5000, cut)] + words[at + cut :])))
        at += cut + 4
    return rows, {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}


@pytest.mark.parametrize("chunk", [128, 3])
def test_similar_groups_of_a_dense_group_are_exact(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    rows, sets = templated("babaababbabaabab")
    truth = {i: min(j for j in sets if j == i or ("babaababbabaabab"[i] == "babaababbabaabab"[j] == "a")) for i in sets}
    assert all((5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) == (truth[i] == truth[j]) for i, j in itertools.combinations(sets, 2))
    assert dict(map(tuple, similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == truth


def test_similar_links_are_checked_however_few_bits_differ(spark):
    """Of many pairs at 0.795 the one with the fewest differing bits, below what was once a link unchecked."""
    prints = lambda t: np.frombuffer(similar.wide_fingerprint(t.encode()), "<u8")
    tried = (templated("ab" * 8, seed)[0] for seed in range(40))
    pairs = ((int(np.bitwise_count(p ^ q).sum()), a[1], b[1]) for rows in tried for made in [[(r, prints(r[1])) for r in rows]] for (a, p), (b, q) in itertools.product(made[::2], made[1::2]))
    bits, a, b = min(pairs)
    assert bits <= 128  # of 1,024
    # A segment is alike, or the pair isn't met at all.
    assert (np.frombuffer(similar.wide_fingerprint(a.encode()), "<u2") == np.frombuffer(similar.wide_fingerprint(b.encode()), "<u2")).any()
    got = similar.similar_groups(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"))
    assert dict(map(tuple, got.collect())) == {0: 0, 1: 1}


@pytest.mark.parametrize("chunk", [50_000, 3])
def test_similar_groups_with_crowded_keys(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar, "KEY_CHUNK", chunk)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(60):
        changed = list(words)
        changed[i * 6] = f"v{i}"
        rows.append((i, " ".join(changed)))
    rows += [(100 + i, " ".join(f"u{k}" for k in rng.integers(0, 5000, 300))) for i in range(10)]
    found = dict(map(tuple, similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == {i: 0 for i in range(60)} | {100 + i: 100 + i for i in range(10)}


def test_similar_texts_without_or_with_one_doc_id(spark):
    x, y = (" ".join(f"{k}{i}" for i in range(200)) for k in "xy")
    rows = [(1, x, 0), (None, x + " z", 1), (None, y, 2), (None, y + " z", 3), (5, y.upper().lower() + " q", 4), (7, "one two", 5), (7, "three four", 6)]
    kept = similar.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, low_id int"))
    assert sorted(r["low_id"] for r in kept.collect()) == [0, 4, 5, 6]
    alone = spark.createDataFrame([(None, y, 2), (None, y + " z", 3)], "doc_id long, text string, low_id int")
    assert similar.drop_near_duplicates(alone).count() == 1


def run_pipeline(spark, folder, docs, labels):
    import corpus_pipeline

    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    kept, stages = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, folder)
        assert stages.columns == docs.columns
        kept[name] = [(r["doc_id"], r["text"]) for r in stages.select("doc_id", "text").collect()]
    return kept, corpus_pipeline.run(spark, folder).collect()


@pytest.mark.parametrize("kind", ["empty", "awkward"])
def test_pipeline_on_awkward_tables(spark, tmp_path, kind):
    rows = awkward() if kind == "awkward" else []
    docs = spark.createDataFrame([(d, t, "en", "s", 1, ["x"], "b", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans array<string>, base string, chosen int")
    kept, packed = run_pipeline(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert sorted(repr(r["doc_id"]) for r in packed if r["piece"] == 0) == sorted(repr(d) for d, _ in kept["personal_data"])
    assert len(kept["quality_classifier"]) == len(rows) and (not rows) == (not packed)


def test_pipeline_equals_plain_stages(spark, sf_dir, tmp_path):
    docs, labels = sf001(spark, sf_dir)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    kept, packed = run_pipeline(spark, tmp_path, docs, labels)
    accepted = kept["quality_classifier"]
    assert any(d is None for d, _ in accepted)
    groups = brute.op2(accepted)
    keep = {(x[4], x[1]) for x in groups}
    digest = lambda t: brute.sha256(brute.SPACE.sub(" ", t or "").encode()).hexdigest()
    assert sorted(map(repr, kept["exact_dedup"])) == sorted(repr(x) for x in accepted if (digest(x[1]), x[0]) in keep)
    sets = []
    for d, t in kept["exact_dedup"]:
        w = brute.WORD.findall(brute.lower(t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    near, stay = {}, {repr(x) for x in kept["simhash_near_dedup"]}
    for i, j in itertools.combinations(range(len(sets)), 2):
        if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
    for i, x in enumerate(kept["exact_dedup"]):
        if repr(x) not in stay:
            assert i in near, "a text without a similar one was dropped"
    rows = list(map(repr, kept["exact_dedup"]))  # equal rows stay together
    both = sum(rows[i] in stay and rows[j] in stay for i in near for j in near[i] if i < j and rows[i] != rows[j])
    assert both <= 0.1 * max(1, sum(map(len, near.values())) / 2)
    assert len(kept["personal_data"]) == len(kept["simhash_near_dedup"])
    assert sorted(repr(r["doc_id"]) for r in packed if r["piece"] == 0) == sorted(repr(d) for d, _ in kept["personal_data"])
